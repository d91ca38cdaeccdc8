"""CSV and JSON readers, writers, and the dataset catalog."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.scalars import as_column, finite_table, null_tokens, parse_number
from tablewright.operators.profile import _long_stats


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header. Give a schema for large files; inference reads them twice."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_csv_tolerant(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """CSV as text cells, trimmed; rows with too few or too many fields are dropped.

    Words that mean missing become null. Columns whose every present value is a
    number become doubles; ``lenient`` also accepts values that only start with one.
    """
    reader = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
    )
    names = reader.option("inferSchema", False).csv(path).columns
    names = [n.strip().replace('"', "") for n in names]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    # without the last option a narrow select would bring the dropped rows back
    rows = reader.schema(schema).option("mode", "DROPMALFORMED").option("columnPruning", False).csv(path)
    cells = rows.select(*[null_tokens(n).alias(n) for n in names])
    if not names:
        return cells
    votes = cells.agg(
        *[F.count_if(as_column(n).isNotNull() & parse_number(n, lenient).isNull()).alias(f"bad{i}") for i, n in enumerate(names)],
        *[F.count(as_column(n)).alias(f"n{i}") for i, n in enumerate(names)],
    ).first()
    return cells.select(
        *[
            parse_number(n, lenient).alias(n) if votes[f"n{i}"] and not votes[f"bad{i}"] else as_column(n)
            for i, n in enumerate(names)
        ]
    )


def read_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines; the columns are the union of the keys, and a missing key is null."""
    reader = spark.read
    return (reader.schema(schema) if schema else reader).json(path)


def cleaned_name(filename: str) -> str:
    """Name of a cleaned copy: ``sales.csv`` becomes ``sales_cleaned.csv``."""
    stem = filename.removesuffix(".csv")
    return f"{stem}.csv" if stem.endswith("_cleaned") else f"{stem}_cleaned.csv"


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with a header; fields with commas or quotes are quoted, quotes doubled."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("escapeQuotes", True)
        .csv(path)
    )


def write_cleaned(df: DataFrame, folder: str, filename: str, mode: str = "error") -> str:
    """Write a cleaned table next to others of its kind; returns the path."""
    path = f"{folder.rstrip('/')}/{cleaned_name(filename)}"
    write_csv(df, path, mode)
    return path


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines; non-finite numbers are written as null."""
    finite_table(df).write.mode(mode).option("ignoreNullFields", False).json(path)


def write_scored(df: DataFrame, path: str, columns: Sequence[str], prediction: str = "prediction", mode: str = "error") -> None:
    """Input rows with their predicted label."""
    write_csv(df.select(*[as_column(c) for c in columns], as_column(prediction).alias("predicted_label")), path, mode)


def catalog(spark: SparkSession, paths: dict[str, str], schemas: dict[str, T.StructType] | None = None) -> DataFrame:
    """One row per dataset and column: rows, columns, type, missing cells, size on disk.

    ``paths`` maps a dataset name to its CSV file or folder.
    """
    out = None
    for name, path in paths.items():
        df = read_csv(spark, path, (schemas or {}).get(name))
        types = {f.name: f.dataType.simpleString() for f in df.schema}
        columns = _long_stats(
            df,
            df.columns,
            lambda c: [
                F.lit(types[c]).alias("dtype"),
                F.count(F.lit(1)).alias("n_rows"),
                F.count_if(as_column(c).isNull()).alias("n_missing"),
            ],
        )
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        size = files.agg(F.round(F.sum("length") / (1024 * 1024), 2).alias("size_mb"))
        # the right side is a single row
        part = columns.crossJoin(size).select(
            F.lit(name).alias("dataset"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), "column", "dtype", "n_missing", "size_mb"
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no dataset given")
    return out


def catalog_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog of every ``*.csv`` file or folder directly inside ``folder``."""
    root = folder.rstrip("/").rsplit("/", 1)[-1]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.regexp_extract("path", f"/{re.escape(root)}/([^/]+\\.csv)(/|$)", 1).alias("name")
    names = sorted(r["name"] for r in files.select(name).distinct().where("name != ''").collect())
    return catalog(spark, {n: f"{folder.rstrip('/')}/{n}" for n in names})
