"""Column profile, numeric and categorical summaries, correlation, outliers."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.quantiles import moments_and_quantiles, order_statistics, quantiles
from tablewright.functions.scalars import (
    as_column,
    finite,
    is_numeric,
    is_temporal,
    measure,
    numeric_columns,
    row_key,
    string_columns,
    text_cell,
)

COLUMNS_PER_PASS = 100  # profiled columns per aggregate, to bound generated code
ROUNDING = 1e-13  # share of its mean square below which a variance is rounding
IQR_FACTOR = 1.5
ENDS = (("first_value", False), ("last_value", True))
SKETCH_BITS = 14  # distinct counts are estimated to about a percent
SKETCH_MARGIN, FEW_VALUES = 0.06, 10  # several times that error, and a margin for small counts
HEAD = 128  # characters of a text that are counted as they are; a digest stands for what follows


def column_kind(data_type: T.DataType) -> str:
    """Physical kind used by the role rules."""
    if is_numeric(data_type):
        return "numeric"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if is_temporal(data_type):
        return "datetime"
    if isinstance(data_type, T.StringType):
        return "string"
    return "complex"


def _rows(spark, records: list[tuple], schema: str) -> DataFrame:
    """Fitted constants (a row per column or pair) as a table."""
    return spark.createDataFrame(records, schema)


def _long_stats(df: DataFrame, columns: Sequence[str], metrics) -> DataFrame:
    """Aggregate ``metrics(name)`` for all columns in one scan, one row per column."""
    parts = []
    for start in range(0, len(columns), COLUMNS_PER_PASS):
        batch = columns[start : start + COLUMNS_PER_PASS]
        # one wide aggregate row, turned into a row per column
        wide = df.agg(*[F.struct(F.lit(c).alias("column"), *metrics(c)).alias(f"m{i}") for i, c in enumerate(batch)])
        parts.append(wide.select(F.inline(F.array(*[F.col(f"m{i}") for i in range(len(batch))]))))
    return reduce(DataFrame.unionByName, parts)


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count of every distinct value of every column, as ``(column, value, count)``.

    One shuffle serves all columns. Values travel as whole text, as the caller
    wants them all; nulls are left out.
    """
    columns = list(columns or df.columns)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), text_cell(df, c).alias("value")) for c in columns])
    long = df.select(F.inline(cells)).where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def _estimated_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(at, n_distinct)``: estimated distinct values, good to a percent; a column without values has no row."""

    def cell(at: int, c: str) -> Column:
        text = text_cell(df, c)
        return F.struct(F.lit(at).alias("at"), F.when(text.isNotNull(), F.xxhash64(text)).alias("cell"))

    cells = df.select(F.inline(F.array(*[cell(i, c) for i, c in enumerate(columns)]))).where(F.col("cell").isNotNull())
    return cells.groupBy("at").agg(F.hll_sketch_estimate(F.hll_sketch_agg("cell", SKETCH_BITS)).alias("n_distinct"))


def _may_be_long(df: DataFrame, name: str) -> bool:
    return column_kind(df.schema[name].dataType) in ("string", "complex")


def _cell_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count of every distinct value, as ``(at, head, digest, n)``; ``at`` is the column's position in the list.

    ``head`` is the start of the value's text. Only a text that goes on has a
    digest, so documents and pages never cross the network themselves.
    """

    def cell(at: int, c: str) -> Column:
        text = text_cell(df, c)
        digest = F.when(F.length(text) > HEAD, F.sha2(text, 256)) if _may_be_long(df, c) else F.lit(None).cast("string")
        head = F.substring(text, 1, HEAD) if _may_be_long(df, c) else text
        return F.struct(F.lit(at).alias("at"), head.alias("head"), digest.alias("digest"))

    cells = df.select(F.inline(F.array(*[cell(i, c) for i, c in enumerate(columns)]))).where(F.col("head").isNotNull())
    return cells.groupBy("at", "head", "digest").agg(F.count(F.lit(1)).alias("n"))


def _with_text(df: DataFrame, columns: Sequence[str], picked: DataFrame) -> DataFrame:
    """The picked cells with their whole ``value``; the few that travelled as digests are looked up in the table."""
    long = [(i, c) for i, c in enumerate(columns) if _may_be_long(df, c)]
    if not long:
        return picked.withColumn("value", F.col("head"))
    cells = F.array(*[F.struct(F.lit(i).alias("at"), text_cell(df, c).alias("value")) for i, c in long])
    texts = df.select(F.inline(cells)).where(F.length("value") > HEAD).select("at", F.sha2("value", 256).alias("digest"), "value")
    wanted = picked.where(F.col("digest").isNotNull()).select("at", "digest").distinct()
    found = texts.join(wanted, ["at", "digest"]).groupBy("at", "digest").agg(F.min("value").alias("value"))
    return picked.join(found, ["at", "digest"], "left").withColumn("value", F.coalesce("value", "head"))


def _names(columns: Sequence[str]) -> Column:
    """The name of the column at position ``at``."""
    return F.get(F.array(*[F.lit(c) for c in columns]), F.col("at")).alias("column")


def _number(df: DataFrame, columns: Sequence[str]) -> Column:
    """Numeric order for cells of numeric columns, so ties break by size, not text."""
    numbers = [i for i, c in enumerate(columns) if is_numeric(df.schema[c].dataType)]
    return F.when(F.col("at").isin(*numbers), F.col("head").try_cast("double")) if numbers else F.lit(None).cast("double")


def _distinct_and_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(at, n_distinct, n_singleton, mode_count, mode)``; the mode is null where no value repeats.

    Ties go to the smallest value. Distinct cells are aggregated by hash only:
    counts per column first, then the smallest of those with the highest count.
    """
    counts = _cell_counts(df, columns)
    levels = counts.groupBy("at").agg(
        F.count(F.lit(1)).alias("n_distinct"), F.count_if(F.col("n") == 1).alias("n_singleton"), F.max("n").alias("mode_count")
    )
    # both broadcast tables have a row per column at most
    repeated = F.broadcast(levels.where("mode_count > 1").select("at", F.col("mode_count").alias("n")))
    tops = counts.join(repeated, ["at", "n"]).select("at", "head", "digest", _number(df, columns).alias("number"))
    best = []
    for start in range(0, len(columns), COLUMNS_PER_PASS):
        part = range(start, min(start + COLUMNS_PER_PASS, len(columns)))
        least = tops.agg(*[F.min(F.when(F.col("at") == i, F.struct("number", "head"))).alias(f"b{i}") for i in part])
        best.append(least.select(F.inline(F.array(*[F.struct(F.lit(i).alias("at"), F.col(f"b{i}.head").alias("head")) for i in part]))))
    winners = tops.join(F.broadcast(reduce(DataFrame.unionByName, best)), ["at", "head"])
    modes = _with_text(df, columns, winners).groupBy("at").agg(F.min("value").alias("mode"))
    return levels.join(modes, "at", "left")


def _extreme(df: DataFrame, name: str, largest: bool = False) -> Column:
    """Smallest or largest value of a column as text; numbers and times are compared as such."""
    pick = F.max if largest else F.min
    data_type = df.schema[name].dataType
    if _may_be_long(df, name):
        return pick(text_cell(df, name))
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return (pick(finite(name)) + F.lit(0.0)).cast("string")
    return pick(as_column(name)).cast("string")


def _sample_std(v: Column) -> Column:
    """Sample deviation; zero for a single value."""
    n = F.count(v)
    return F.when(n == 1, 0.0).otherwise(F.sqrt(F.var_pop(v) * n / F.nullif(n - 1, F.lit(0))))


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Profile of every column: one row per column.

    One scan gives counts, moments, lengths and the smallest and largest value;
    one unpivoted group-by gives distinct and singleton counts and the mode.
    ``exact=False`` skips the group-by and estimates distinct counts; singletons
    and modes are then not known and their columns are left out.
    """
    columns = list(columns or df.columns)
    schema = df.schema

    def metrics(c: str) -> list[Column]:
        # aggregates a column has no use for are plain nulls, so they cost nothing
        kind = column_kind(schema[c].dataType)
        rows = F.count(F.lit(1))
        nothing = F.lit(None).cast("double")
        if kind == "numeric":
            number = measure(df, c)
            present = F.count(number)
            numbers = [F.sum(number) / F.nullif(present, F.lit(0)), _sample_std(number), F.min(number), F.max(number)]
        else:
            present = F.count(as_column(c))
            numbers = [nothing] * 4
        if kind == "string":
            text = as_column(c)
            url, email = text.contains("http") | text.contains("www."), text.contains("@") & text.contains(".")
            texts = [F.avg(F.length(text)), F.max(F.length(text)), F.avg(url.cast("int")), F.avg(email.cast("int"))]
        else:
            texts = [nothing] * 4
        out = [
            F.lit(columns.index(c)).alias("position"),
            F.lit(kind).alias("kind"),
            rows.alias("n_rows"),
            (rows - present).alias("n_missing"),
            *[v.cast("double").alias(n) for n, v in zip(("mean", "std", "min", "max"), numbers)],
            texts[0].cast("double").alias("avg_length"),
            texts[1].cast("long").alias("max_length"),
            texts[2].cast("double").alias("url_share"),
            texts[3].cast("double").alias("email_share"),
            *[(nothing.cast("string") if _may_be_long(df, c) else _extreme(df, c, last)).alias(n) for n, last in ENDS],
        ]
        return out

    stats = _long_stats(df, columns, metrics)
    texts = [c for c in columns if _may_be_long(df, c)]
    if texts:
        # apart from the numbers, whose aggregates would lose generated code beside minima of texts
        ends = _long_stats(df, texts, lambda c: [F.lit(columns.index(c)).alias("position"), *[_extreme(df, c, last).alias(f"text_{n}") for n, last in ENDS]])
        stats = stats.join(F.broadcast(ends.drop("column")), "position", "left").withColumns({n: F.coalesce(n, f"text_{n}") for n, _ in ENDS}).drop(*[f"text_{n}" for n, _ in ENDS])
    if exact:
        counted = _distinct_and_mode(df, columns).withColumnRenamed("at", "position")
        stats = stats.join(F.broadcast(counted), "position", "left").withColumns(
            {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_distinct", "n_singleton", "mode_count")}
        )
        # where nothing repeats, the smallest value is the mode
        stats = stats.withColumn("mode", F.coalesce("mode", "first_value"))
    else:
        guess = F.broadcast(_estimated_counts(df, columns).withColumnRenamed("at", "position"))
        stats = stats.join(guess, "position", "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))
    return stats.withColumns(
        {
            "ratio": F.try_divide(F.col("n_distinct"), F.col("n_rows")),
            "pct_missing": F.coalesce(F.try_divide(F.col("n_missing") * 100, F.col("n_rows")), F.lit(0.0)),
        }
    )


def fit_moments(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, dict]:
    """Count, nulls, mean, deviations, variances and range of numeric columns."""
    columns = numeric_columns(df) if columns is None else list(columns)
    if not columns:
        return {}

    def metrics(c: str) -> list[Column]:
        v = measure(df, c)
        return [
            F.count(v).alias("count"),
            (F.count(F.lit(1)) - F.count(v)).alias("nulls"),
            F.sum(v).alias("sum"),
            F.var_pop(v).alias("var_pop"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
        ]

    found = {}
    for row in _long_stats(df, columns, metrics).collect():  # a row per column
        m = row.asDict()
        n, spread = m["count"], m["var_pop"]
        m["mean"] = m["sum"] / n if n else None
        m["std_pop"] = math.sqrt(spread) if n else None
        m["var"] = spread * n / (n - 1) if n > 1 else None
        m["std"] = math.sqrt(m["var"]) if n > 1 else None
        found[row["column"]] = m
    return found


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Distinct non-null values per column."""
    columns = list(columns or df.columns)
    counted = _cell_counts(df, columns).groupBy("at").agg(F.count(F.lit(1)).alias("n_distinct")) if exact else _estimated_counts(df, columns)
    found = counted.select(_names(columns), "n_distinct")
    names = _rows(df.sparkSession, [(c,) for c in columns], "column string")
    return names.join(found, "column", "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))


def fit_distinct(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    columns = list(columns)
    return {r["column"]: r["n_distinct"] for r in distinct_counts(df, columns).collect()} if columns else {}


def fit_open_distinct(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> dict[str, bool | None]:
    """Whether each column has more than the first and fewer than the second number of distinct values; None if open.

    One scan of sketches settles all columns whose estimate lies outside of many times its error around both bounds.
    """
    columns = list(bounds)
    if not columns:
        return {}
    guess = {columns[r["at"]]: r["n_distinct"] for r in _estimated_counts(df, columns).collect()}  # a row per column
    out: dict[str, bool | None] = {}
    for c, (low, high) in bounds.items():
        n = guess.get(c, 0)
        least, most = n * (1 - SKETCH_MARGIN) - FEW_VALUES, n * (1 + SKETCH_MARGIN) + FEW_VALUES
        out[c] = True if low < least and most < high else False if most <= low or least >= high else None
    return out


def fit_distinct_within(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> dict[str, bool]:
    """As :func:`fit_open_distinct`; the distinct values of the columns left open are counted, and only theirs."""
    told = fit_open_distinct(df, bounds)
    counts = fit_distinct(df, [c for c, known in told.items() if known is None])
    return {c: bounds[c][0] < counts[c] < bounds[c][1] if known is None else known for c, known in told.items()}


def distinct_counts_within(df: DataFrame, columns: Sequence[str], low: float, high: float) -> DataFrame:
    """:func:`distinct_counts` of the columns with more than ``low`` and fewer than ``high`` values.

    Columns that a sketch rules out are not counted.
    """
    told = fit_open_distinct(df, {c: (low, high) for c in columns})
    left = [c for c, known in told.items() if known is not False]
    counted = distinct_counts(df, left) if left else _rows(df.sparkSession, [], "column string, n_distinct long")
    return counted.where((F.col("n_distinct") > low) & (F.col("n_distinct") < high))


def fit_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value per column as text; the smallest of tied values."""
    columns = list(columns)
    if not columns:
        return {}
    found = {columns[r["at"]]: r for r in _distinct_and_mode(df, columns).collect()}  # a row per column
    single = [c for c in columns if c in found and found[c]["mode_count"] == 1]
    least = df.agg(*[_extreme(df, c).alias(f"m{i}") for i, c in enumerate(single)]).first() if single else []
    return {c: found[c]["mode"] if c in found else None for c in columns} | dict(zip(single, least))


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Mean, deviation, quartiles, range, counts and distinct values per numeric column."""
    columns = numeric_columns(df) if columns is None else list(columns)
    moments, cuts = moments_and_quantiles(df, columns, [0.25, 0.5, 0.75], exact)
    records = []
    for c in columns:
        m = moments[c]
        std = 0.0 if m["count"] == 1 else m["std"]
        q1, median, q3 = cuts[c]
        records.append((c, m["count"], m["nulls"], m["mean"], std, m["min"], q1, median, q3, m["max"]))
    summary = _rows(
        df.sparkSession,
        records,
        "column string, count long, nulls long, mean double, std double, min double, q1 double, "
        "median double, q3 double, max double",
    )
    return summary.join(distinct_counts(df, columns, exact), "column")


QUARTILES = [0.25, 0.5, 0.75]


def describe(df: DataFrame, columns: Sequence[str] | None = None, fitted: tuple[dict, dict] | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum per numeric column.

    ``fitted`` has the moments and quartiles of the columns, where the caller knows them.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    moments, cuts = fitted or moments_and_quantiles(df, columns, QUARTILES)
    return _rows(
        df.sparkSession,
        [
            (c, moments[c]["count"], moments[c]["mean"], moments[c]["std"], moments[c]["min"], *cuts[c], moments[c]["max"])
            for c in columns
        ],
        "column string, count long, mean double, std double, min double, q25 double, q50 double, q75 double, max double",
    )


def missing_counts(df: DataFrame) -> DataFrame:
    """Missing cells and their percentage per column."""

    def metrics(c: str) -> list[Column]:
        floats = isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))
        missing = F.count_if((finite(c) if floats else as_column(c)).isNull())
        return [
            missing.alias("n_missing"),
            F.coalesce(F.try_divide(missing * 100, F.count(F.lit(1))), F.lit(0.0)).alias("pct_missing"),
        ]

    return _long_stats(df, df.columns, metrics)


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values of each column; ties in value order."""
    columns = string_columns(df) if columns is None else list(columns)
    if not columns:
        return _rows(df.sparkSession, [], "column string, rank int, value string, count long")
    counts = _cell_counts(df, columns).withColumn("number", _number(df, columns))
    place = F.struct((-F.col("n")).alias("n"), "number", "head")
    # the last place that counts; cells that tie with it stay until their whole texts are known
    by_head = Window.partitionBy("at").orderBy(place)
    first = counts.withColumn("rank", F.row_number().over(by_head)).where(F.col("rank") <= k)
    last = F.broadcast(first.groupBy("at").agg(F.max(place).alias("last")))
    kept = counts.join(last, "at").where(place <= F.col("last")).drop("last")
    order = [F.col("n").desc(), F.col("number").asc(), F.col("value").asc()]
    ranked = _with_text(df, columns, kept).withColumn("rank", F.row_number().over(Window.partitionBy("at").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select(_names(columns), "rank", "value", F.col("n").alias("count"))


def categorical_summary(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """Top values of each text column next to its distinct, present and null counts."""
    columns = string_columns(df) if columns is None else list(columns)
    profile = column_profile(df, columns).select(
        "column", "n_distinct", (F.col("n_rows") - F.col("n_missing")).alias("n_present"), "n_missing"
    )
    return profile.join(top_values(df, columns, k), "column", "left")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows, distinct rows, and copies beyond the first."""
    groups = df.groupBy(*row_key(df)).agg(F.count(F.lit(1)).alias("copies"))
    return groups.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct_rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("n_duplicates"),
    )


_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a partition for every pair of its columns, over the rows where both are present, by matrix products."""
    total = None
    for batch in batches:
        x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])
        there = ~np.isnan(x)
        if total is None:
            d = x.shape[1]
            total, (i, j) = {c: np.zeros((d, d)) for c in ("n", "x", "xx", "xy")}, np.triu_indices(d, 1)
        full = bool(there.all())
        x = x if full else np.where(there, x, 0.0)
        mask = there.astype(np.float64)
        total["xy"] += x.T @ x
        # column sums over the rows where the other column is present
        total["n"] += len(x) if full else mask.T @ mask
        total["x"] += x.sum(axis=0)[:, None] if full else x.T @ mask
        total["xx"] += (x * x).sum(axis=0)[:, None] if full else (x * x).T @ mask
    if total is not None:
        n, sx, sxx, sxy = (total[c] for c in ("n", "x", "xx", "xy"))
        sums = [n[i, j].astype(np.int64), sx[i, j], sx[j, i], sxx[i, j], sxx[j, i], sxy[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *map(pa.array, sums)], ["i", "j", *_SUMS])


def correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns over rows where both are present.

    Null when either column is constant on those rows. One scan serves all pairs: each task multiplies its rows, with
    and without their gaps, as matrices, and the sums of the tasks are added up by pair.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    d = len(columns)
    if d < 2:
        return _rows(df.sparkSession, [], "column1 string, column2 string, correlation double")
    moments = fit_moments(df, columns)
    # columns are centred and scaled first, so sums stay exact to work with
    scaled = df.select(
        *[
            ((measure(df, c) - F.lit(m["mean"])) / F.lit(m["std_pop"] or None)).cast("double").alias(f"c{k}")
            if m["std_pop"]
            else F.lit(None).cast("double").alias(f"c{k}")
            for k, (c, m) in enumerate(moments.items())
        ]
    )
    sums = scaled.mapInArrow(_gram, "i long, j long, n long, sx double, sy double, sxx double, syy double, sxy double")
    sums = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _SUMS])
    n = F.nullif(F.col("n"), F.lit(0))

    def spread(total: str, squares: str) -> Column:
        """Variance; what rounding leaves of a constant counts as none."""
        square = F.col(squares) / n
        variance = square - F.pow(F.col(total) / n, 2)
        return F.when(variance > ROUNDING * square, variance)

    covariance = F.col("sxy") / n - F.col("sx") / n * F.col("sy") / n
    r = covariance / F.sqrt(spread("sx", "sxx") * spread("sy", "syy"))
    at = df.sparkSession.range(d * d).select((F.col("id") / d).cast("long").alias("i"), (F.col("id") % d).alias("j")).where("i < j")
    names = F.array(*[F.lit(c) for c in columns])
    found = at.join(sums, ["i", "j"], "left")
    return found.select(F.get(names, F.col("i").cast("int")).alias("column1"), F.get(names, F.col("j").cast("int")).alias("column2"), r.alias("correlation"))


def correlation_cells(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The whole matrix in long form, both triangles and the diagonal."""
    columns = numeric_columns(df) if columns is None else list(columns)
    upper = correlation(df, columns)
    lower = upper.select(F.col("column2").alias("column1"), F.col("column1").alias("column2"), "correlation")
    moments = fit_moments(df, columns)
    diagonal = _rows(
        df.sparkSession,
        [(c, c, 1.0 if moments[c]["std_pop"] else None) for c in columns],
        "column1 string, column2 string, correlation double",
    )
    return upper.unionByName(lower).unionByName(diagonal)


def high_correlations(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.8) -> DataFrame:
    """Pairs whose correlation is beyond the threshold in absolute value."""
    return correlation(df, columns).where(F.abs("correlation") > threshold)


def _fence(q1: float | None, q3: float | None) -> tuple[float, float] | None:
    if q1 is None:
        return None
    reach = IQR_FACTOR * (q3 - q1)
    return q1 - reach, q3 + reach


def fit_iqr_bounds(
    df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True, by_rank: bool = False
) -> dict[str, tuple[float, float] | None]:
    """Lower and upper fence of each column; None for a column without values."""
    columns = numeric_columns(df) if columns is None else list(columns)
    if by_rank:
        cuts = order_statistics(df, columns, [0.25, 0.75], interpolate=False)
    else:
        cuts = quantiles(df, columns, [0.25, 0.75], exact)
    return {c: _fence(*cuts[c]) for c in columns}


def iqr_outliers(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    exact: bool = True,
    by_rank: bool = False,
    quartiles: dict[str, list[float | None]] | None = None,
) -> DataFrame:
    """Values beyond the fences: count, share of all rows, and the fences.

    ``quartiles`` has the three quartiles of each column, where the caller knows them.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    if quartiles is None:
        fences = fit_iqr_bounds(df, columns, exact, by_rank)
    else:
        fences = {c: _fence(quartiles[c][0], quartiles[c][2]) for c in columns}

    def metrics(c: str) -> list[Column]:
        low, high = fences[c] or (None, None)
        v = measure(df, c)
        count = F.count_if((v < F.lit(low).cast("double")) | (v > F.lit(high).cast("double")))
        return [
            count.alias("n_outliers"),
            F.coalesce(F.try_divide(count * 100, F.count(F.lit(1))), F.lit(0.0)).alias("pct_outliers"),
            F.lit(low).cast("double").alias("lower_bound"),
            F.lit(high).cast("double").alias("upper_bound"),
        ]

    return _long_stats(df, columns, metrics)


def describe_with_quality(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Describe, missing cells and outliers side by side, one row per numeric column."""
    columns = numeric_columns(df) if columns is None else list(columns)
    fitted = moments_and_quantiles(df, columns, QUARTILES)
    return (
        describe(df, columns, fitted)
        .join(missing_counts(df.select(*[as_column(c) for c in columns])), "column")
        .join(iqr_outliers(df, columns, quartiles=fitted[1]), "column")
    )
