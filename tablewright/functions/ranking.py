"""Row numbers that do not put a whole group into one task.

A window over a partition key sorts each group in a single task, which fails
when one class or stratum holds a third of the table. Here the group is split
into buckets that are already in order, each bucket is numbered on its own, and
the number of rows in earlier buckets is added.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.scalars import as_column
from tablewright.session import checkpoint

PLACE_BITS = 33  # of a monotonically increasing id, that count the rows of a partition
BUCKET_ROWS = 500_000  # rows a hash bucket should hold at most


def bucket_bits(rows: int) -> int:
    """Leading hash bits that make buckets of about the wanted size."""
    return min(24, max(3, math.ceil(math.log2(max(1, rows / BUCKET_ROWS)))))


def row_hash(keys: Sequence[str | Column], seed: int) -> Column:
    """Seeded 64-bit hash that orders rows at random but repeatably."""
    return F.xxhash64(F.lit(seed), *[as_column(k) for k in keys])


def hashed_row_number(
    df: DataFrame,
    groups: Sequence[str],
    keys: Sequence[str],
    seed: int,
    name: str,
    rows: int,
    group_size: str = "_group_size",
    at_most: Column | None = None,
) -> DataFrame:
    """Number the rows of each group in hash order, from 1.

    The leading bits of the hash are the bucket, so buckets of any group are
    even in size; ``rows``, the size of the table, sets how many bits. The number
    of rows of the group is added as ``group_size``. ``at_most``, which may use
    it, drops buckets that lie wholly beyond a quota before anything is sorted.
    """
    bits = bucket_bits(rows)
    # a text form of the group is never null, so one shuffle serves join and window
    group = F.to_json(F.struct(*[as_column(g) for g in groups]))
    keyed = df.withColumn("_group", group).withColumn("_hash", row_hash(keys, seed))
    keyed = keyed.withColumn("_bucket", F.shiftright("_hash", 64 - bits))
    sizes = keyed.groupBy("_group", "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    whole = Window.partitionBy("_group")
    sizes = sizes.select(
        "_group",
        "_bucket",
        (F.sum("_size").over(whole.orderBy("_bucket")) - F.col("_size")).alias("_before"),
        F.sum("_size").over(whole).alias(group_size),
    )
    joined = keyed.join(sizes, ["_group", "_bucket"])
    if at_most is not None:
        joined = joined.where(F.col("_before") < at_most)
    inside = Window.partitionBy("_group", "_bucket").orderBy("_hash", *[as_column(k) for k in keys])
    numbered = joined.withColumn(name, F.col("_before") + F.row_number().over(inside))
    if at_most is not None:
        numbered = numbered.where(F.col(name) <= at_most)
    return numbered.drop("_group", "_hash", "_bucket", "_before")


def ordered_row_number(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Number all rows by ``order``, from 1, without a single-task sort.

    Rows are range-partitioned and sorted once; a row's number is its place in
    its partition plus the rows of the partitions before. The checkpoint pins
    both, since range bounds are sampled anew on each run.
    """
    cols = [as_column(c) for c in order]
    ranged = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    ranged = checkpoint(ranged.withColumn("_at", F.monotonically_increasing_id()))
    bucket = F.shiftright("_at", PLACE_BITS)
    sizes = ranged.groupBy(bucket.alias("_bucket")).count()
    total = Window.orderBy("_bucket")  # one row per partition
    sizes = sizes.select(F.col("_bucket"), (F.sum("count").over(total) - F.col("count")).alias("_before"))
    numbered = ranged.withColumn("_bucket", bucket).join(F.broadcast(sizes), "_bucket")  # a row per partition
    place = F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return numbered.withColumn(name, F.col("_before") + place + 1).drop("_bucket", "_before", "_at")
