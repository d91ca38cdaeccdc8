"""Missing values, duplicates and outliers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.quantiles import quantiles
from tablewright.functions.scalars import (
    UNKNOWN,
    as_column,
    finite_table,
    is_numeric,
    measure,
    numeric_columns,
    string_columns,
)
from tablewright.operators.profile import fit_iqr_bounds, fit_modes, fit_moments
from tablewright.session import checkpoint, scratch_path


def _fill(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Replace nulls; the value's type wins, so an integer column can take a mean."""
    return df.select(
        *[
            F.coalesce(measure(df, c) if is_numeric(df.schema[c].dataType) else as_column(c), values[c]).alias(c)
            if c in values
            else as_column(c)
            for c in df.columns
        ]
    )


def _with_gaps(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns that hold a missing cell."""
    if not columns:
        return []
    gaps = df.agg(
        *[
            F.count_if((measure(df, c) if is_numeric(df.schema[c].dataType) else as_column(c)).isNull()).alias(c)
            for c in columns
        ]
    ).first()
    return [c for c in columns if gaps[c]]


def _typed(df: DataFrame, name: str, text: str | None) -> Column:
    """A fitted value that was carried as text, in the type of its column."""
    if text is None:
        return F.lit(0.0) if is_numeric(df.schema[name].dataType) else F.lit(UNKNOWN)
    value = F.lit(text)
    return value.cast("double") if is_numeric(df.schema[name].dataType) else value.cast(df.schema[name].dataType)


def drop_missing(df: DataFrame) -> DataFrame:
    """Keep rows without a missing cell."""
    return finite_table(df).na.drop("any")


def fill_mean(df: DataFrame) -> DataFrame:
    """Numeric gaps take the column mean, text gaps the mode."""
    numbers = _with_gaps(df, numeric_columns(df))
    texts = _with_gaps(df, string_columns(df))
    moments = fit_moments(df, numbers)
    modes = fit_modes(df, texts)
    values = {c: F.lit(moments[c]["mean"]).cast("double") for c in numbers}
    values |= {c: _typed(df, c, modes[c]) for c in texts}
    return _fill(df, values)


def fill_mode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Gaps take the column's most frequent value, the smallest of tied ones."""
    simple = [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    gaps = _with_gaps(df, [c for c in columns or simple if c in simple])
    modes = fit_modes(df, gaps)
    return _fill(df, {c: _typed(df, c, modes[c]) for c in gaps})


def fill_median(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Numeric gaps take the median, or zero in a column without values."""
    gaps = _with_gaps(df, numeric_columns(df) if columns is None else list(columns))
    medians = quantiles(df, gaps, [0.5], exact)
    return _fill(df, {c: F.lit(0.0 if medians[c][0] is None else medians[c][0]) for c in gaps})


def fill_zero(df: DataFrame) -> DataFrame:
    """Numeric gaps take zero, text gaps the unknown label."""
    return finite_table(df).na.fill(0).na.fill(UNKNOWN)


def _carried_forward(key: int, filled: Sequence[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of key and time; the last row of a batch, filled, goes in front of the next one."""
        last: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is not None:
                batch = pa.concat_batches([last, batch])
            names = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy()
            places = np.arange(batch.num_rows)
            new = np.ones(batch.num_rows, bool)
            new[1:] = names[1:] != names[:-1]
            begin = np.maximum.accumulate(np.where(new, places, 0))
            columns = list(batch.columns)
            for c in filled:
                there = columns[c].is_valid().to_numpy(zero_copy_only=False)
                source = np.maximum.accumulate(np.where(there, places, -1))
                columns[c] = columns[c].take(pa.array(source, mask=source < begin))
            out = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield out if last is None else out.slice(1)
            last = out.slice(batch.num_rows - 1)

    return run


def forward_fill(df: DataFrame, key: str, order_by: str, columns: Sequence[str]) -> DataFrame:
    """Gaps take the last earlier value of the same key.

    ``order_by`` must be unique within a key. The table is exchanged and sorted
    once. Rows are range-partitioned by key and order, so a key with very many
    rows is cut into consecutive stretches that different tasks fill; only a
    stretch's first key can go on from the stretch before, and only the last
    values of each stretch are passed on.
    """
    order = [as_column(key), as_column(order_by)]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_stretch", F.spark_partition_id())
    # range bounds are sampled anew on each run, so the cut is pinned here
    ranged = checkpoint(ranged)
    filled = ranged.mapInArrow(_carried_forward(ranged.columns.index(key), [ranged.columns.index(c) for c in columns]), ranged.schema)
    # structs, as nulls in them are equal, and come first as in the sort
    place = F.struct(as_column(key).isNotNull().alias("named"), as_column(key).alias("key"))
    then = F.struct(place.alias("k"), F.struct(as_column(order_by).isNotNull().alias("known"), as_column(order_by).alias("at")).alias("o"))
    last = [F.max_by(F.struct(place.alias("k"), as_column(c).alias("v")), F.when(as_column(c).isNotNull(), then)).alias(f"_l{i}") for i, c in enumerate(columns)]
    ends = ranged.groupBy("_stretch").agg(F.min(place).alias("_first"), F.max(place).alias("_last"), *last)
    known = [F.when(F.col(f"_l{i}.k") == F.col("_last"), F.col(f"_l{i}.v")).alias(f"_v{i}") for i in range(len(columns))]
    ends = ends.select("_stretch", "_first", "_last", *known)
    running = Window.partitionBy("_last").orderBy("_stretch")
    before = Window.orderBy("_stretch")  # a row per stretch
    ends = ends.select("_stretch", "_first", "_last", *[F.last(f"_v{i}", ignorenulls=True).over(running).alias(f"_v{i}") for i in range(len(columns))])
    goes_on = F.lag("_last").over(before) == F.col("_first")
    carried = ends.select("_stretch", "_first", *[F.when(goes_on, F.lag(f"_v{i}").over(before)).alias(f"_carry{i}") for i in range(len(columns))])
    joined = filled.join(F.broadcast(carried), "_stretch")
    full = {c: F.coalesce(as_column(c), F.when(F.col("_first") == place, F.col(f"_carry{i}"))).alias(c) for i, c in enumerate(columns)}
    return joined.select(*[full[c] if c in full else as_column(c) for c in df.columns])


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Keep one copy of every row."""
    return df.dropDuplicates()


def keep_one(df: DataFrame, key: Sequence[str], order_by: str, keep: str = "first") -> DataFrame:
    """Keep the first or last row of each key by ``order_by``.

    The limit on the row number is applied before the shuffle as well, so each
    task sends at most one row per key.
    """
    order = as_column(order_by).asc() if keep == "first" else as_column(order_by).desc()
    window = Window.partitionBy(*[as_column(k) for k in key]).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") == 1).drop("_rn")


def _inside(fences: dict[str, tuple[float, float] | None]) -> Column:
    """Rows within all fences.

    A non-finite cell fails a finite range by itself, so the bare column is
    compared and the filter reaches the scan.
    """
    keep = F.lit(True)
    for c, fence in fences.items():
        keep = keep & (as_column(c).between(*map(F.lit, fence)) if fence else F.lit(False))
    return keep


def remove_outliers(
    df: DataFrame, columns: Sequence[str] | None = None, simultaneous: bool = False, exact: bool = True
) -> DataFrame:
    """Drop rows beyond the quartile fences; rows without a value go too.

    By default each column's fences come from the rows the earlier columns left,
    in schema order. ``simultaneous`` fits all fences on the input in one go. For
    the cascade the table itself is read once: the columns, and no others, go to a
    table of their own, from which all fences are fitted. A later fence reads only
    the rows that are left, as the earlier ones are pushed down to its scan.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    if simultaneous or len(columns) < 2:
        return df.where(_inside(fit_iqr_bounds(df, columns, exact)))
    path = scratch_path(df.sparkSession, "measures")
    df.select(*[as_column(c).alias(f"c{i}") for i, c in enumerate(columns)]).write.parquet(path)
    narrow, fences = df.sparkSession.read.parquet(path), {}
    for i, c in enumerate(columns):
        own = fit_iqr_bounds(narrow, [f"c{i}"], exact)
        narrow = narrow.where(_inside(own))
        fences[c] = own[f"c{i}"]
    return df.where(_inside(fences))


def cap_outliers(
    df: DataFrame, columns: Sequence[str] | None = None, low: float = 0.05, high: float = 0.95, exact: bool = True
) -> DataFrame:
    """Limit values to the given percentiles."""
    columns = numeric_columns(df) if columns is None else list(columns)
    cuts = quantiles(df, columns, [low, high], exact)

    def capped(c: str) -> Column:
        lo, hi = cuts[c]
        if lo is None:
            return as_column(c)
        v = measure(df, c)
        return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(lo)), F.lit(hi))).alias(c)

    return df.select(*[capped(c) if c in cuts else as_column(c) for c in df.columns])


def remove_z_outliers(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 3.0) -> DataFrame:
    """Keep rows within ``threshold`` sample deviations of every column's mean."""
    columns = numeric_columns(df) if columns is None else list(columns)
    moments = fit_moments(df, columns)
    keep = F.lit(True)
    for c in columns:
        mean, std = F.lit(moments[c]["mean"]).cast("double"), F.lit(moments[c]["std"]).cast("double")
        keep = keep & (F.abs(measure(df, c) - mean) <= threshold * std)
    return df.where(keep)
