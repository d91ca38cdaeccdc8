"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.session import scratch_path

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc_of_id(column: str = "doc_id") -> Column:
    """Unsigned CRC-32 of an id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, name: str = "_row") -> tuple[DataFrame, str]:
    """``df``, written, with a distinct long for every row, and the name of that column, which no other has."""
    row = free_name(df, name)
    return written(df.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def written(df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a cut in the lineage that survives lost executors.

    ``batch_bytes`` bounds the batches that Python functions of this write get, where rows are large.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(BATCH_BYTES)
    try:
        if batch_bytes:
            spark.conf.set(BATCH_BYTES, str(batch_bytes))
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_BYTES, before)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder, as a plain path, that the driver and every executor can open.

    Only for files that must be mapped into memory. The shared folder then has to be a mounted file system.
    """
    place = urlparse(scratch_path(spark, name))
    if place.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need spark.checkpoint.dir on a mounted file system, not {place.scheme}://")
    path = unquote(place.path)
    os.makedirs(path, exist_ok=True)
    return path


def input_partitions(df: DataFrame) -> int:
    """How many tasks read ``df``; grows with its size."""
    return max(1, df.rdd.getNumPartitions())
