"""Feature selection, principal components, sampling and dictionary encoding."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.ranking import hashed_row_number, ordered_row_number, row_hash
from tablewright.functions.scalars import as_column, measure, numeric_columns, string_columns
from tablewright.operators.profile import _rows, fit_distinct_within, fit_moments

# Fixed values of the reduction step.
VARIANCE_FLOOR = 0.01
PCA_SHARE = 0.95
SAMPLE_ROWS = 1000
ENCODE_SHARE = 0.8
SEED = 42



@dataclass(frozen=True)
class ReduceOptions:
    """Steps of :func:`reduce_table`, applied in this order."""

    feature_selection: bool = True
    pca: bool = False
    sampling: bool = False
    compress: bool = False


def variance_threshold(df: DataFrame, floor: float = VARIANCE_FLOOR) -> DataFrame:
    """Drop numeric columns whose population variance does not exceed the floor."""
    numbers = numeric_columns(df)
    if len(numbers) < 2:
        return df
    moments = fit_moments(df, numbers)
    dropped = {c for c in numbers if not (moments[c]["var_pop"] or 0.0) > floor}
    return df.select(*[as_column(c) for c in df.columns if c not in dropped])


def pca_fit(df: DataFrame, columns: Sequence[str], share: float = PCA_SHARE) -> tuple[dict, list, list]:
    """Means, loadings (a list per component) and explained shares of the kept components."""
    moments = fit_moments(df, columns)
    means = {c: moments[c]["mean"] or 0.0 for c in columns}
    filled = df.select(*[F.coalesce(measure(df, c), F.lit(means[c])).alias(f"v{i}") for i, c in enumerate(columns)])
    names = [f"v{i}" for i in range(len(columns))]
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(filled)
    model = PCA(k=len(columns), inputCol="features", outputCol="pcs").fit(assembled)
    shares = [float(v) for v in model.explainedVariance]
    loadings, total, kept = [], 0.0, []
    for j, part in enumerate(shares):
        column = [float(v) for v in model.pc.toArray()[:, j]]
        # the sign of a component is arbitrary: make its largest loading positive
        sign = -1.0 if max(column, key=abs) < 0 else 1.0
        loadings.append([sign * v for v in column])
        kept.append(part)
        total += part
        if total > share:
            break
    return means, loadings, kept


def pca(df: DataFrame, share: float = PCA_SHARE) -> DataFrame:
    """Replace numeric columns with the fewest components that explain the share of variance."""
    numbers = numeric_columns(df)
    if len(numbers) <= 2:
        return df
    means, loadings, _ = pca_fit(df, numbers, share)
    centred = [F.coalesce(measure(df, c) - F.lit(means[c]), F.lit(0.0)) for c in numbers]
    scores = [
        sum((x * F.lit(w) for x, w in zip(centred, weights)), F.lit(0.0)).alias(f"PC{j + 1}")
        for j, weights in enumerate(loadings)
    ]
    return df.select(*[as_column(c) for c in df.columns if c not in numbers], *scores)


def pca_report(df: DataFrame, share: float = PCA_SHARE) -> DataFrame:
    """Explained share of each kept component."""
    _, _, kept = pca_fit(df, numeric_columns(df), share)
    return _rows(
        df.sparkSession,
        [(i + 1, v, sum(kept[: i + 1])) for i, v in enumerate(kept)],
        "component int, explained double, cumulative double",
    )


def uniform_sample(df: DataFrame, key: Sequence[str], rows: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """Exactly ``rows`` rows chosen by seeded hash of the key; the same for any partitioning."""
    return df.orderBy(row_hash(key, seed), *[as_column(k) for k in key]).limit(rows)


def stratified_sample(
    df: DataFrame, stratum: str, key: Sequence[str], rows: int = SAMPLE_ROWS, seed: int = SEED
) -> DataFrame:
    """Sample each stratum in proportion, at least one row each; rows without a stratum are left out."""
    total = df.count()
    if total <= rows:
        return df
    quota = F.greatest(F.lit(1), F.floor(F.lit(rows) * F.col("_group_size") / F.lit(total)))
    present = df.where(as_column(stratum).isNotNull())
    picked = hashed_row_number(present, [stratum], key, seed, "_rn", total, at_most=quota)
    return picked.select(*[as_column(c) for c in df.columns])


def first_seen(df: DataFrame, column: str, order_by: str) -> DataFrame:
    """Dictionary of a column: a code per value in order of first appearance, from 0."""
    firsts = df.groupBy(as_column(column).alias("value")).agg(F.min(as_column(order_by)).alias("first_at"))
    return ordered_row_number(firsts, ["first_at"], "_rn").select("value", (F.col("_rn") - 1).alias("code"))


def dictionary_encode(df: DataFrame, order_by: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Add ``{column}_encoded`` for text columns that repeat enough to be worth it."""
    columns = string_columns(df) if columns is None else list(columns)
    repeats = fit_distinct_within(df, {c: (-1, ENCODE_SHARE * df.count()) for c in columns})
    for c in [c for c in columns if repeats[c]]:
        lookup = first_seen(df, c, order_by).select(F.col("value").alias("_value"), F.col("code").alias(f"{c}_encoded"))
        df = df.join(lookup, as_column(c).eqNullSafe(F.col("_value")), "left").drop("_value")
    return df


def dictionaries(before: DataFrame, encoded: DataFrame) -> dict[str, DataFrame]:
    """``(value, code)`` of every column of ``encoded`` that :func:`dictionary_encode` has added to those ``before``."""
    found = {}
    for c in string_columns(before):
        code = f"{c}_encoded"
        if c in encoded.columns and code in encoded.columns and code not in before.columns:
            found[c] = encoded.select(as_column(c).alias("value"), as_column(code).alias("code")).distinct()
    return found


def reduction_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows and columns before and after, and the share of cells saved."""
    n0, n1 = before.agg(F.count(F.lit(1)).alias("rows_before")), after.agg(F.count(F.lit(1)).alias("rows_after"))
    c0, c1 = len(before.columns), len(after.columns)
    rows0, rows1 = n0.first()[0], n1.first()[0]
    saved = 100.0 * (1 - rows1 * c1 / (rows0 * c0)) if rows0 else 0.0
    return _rows(
        before.sparkSession,
        [(rows0, c0, rows1, c1, saved)],
        "rows_before long, columns_before long, rows_after long, columns_after long, pct_reduction double",
    )


def reduce_table(df: DataFrame, key: str, options: ReduceOptions = ReduceOptions()) -> DataFrame:
    """Apply the chosen steps in order; ``key`` names the row for sampling and encoding."""
    original = df
    if options.feature_selection:
        df = variance_threshold(df)
    if options.pca:
        if key in numeric_columns(df):
            # the key is row identity, not a measurement
            kept = df.withColumn(key, as_column(key).cast("string"))
            df = pca(kept).withColumn(key, as_column(key).cast(original.schema[key].dataType))
        else:
            df = pca(df)
    if options.sampling:
        texts = [c for c in string_columns(df) if c != key]
        df = stratified_sample(df, texts[0], [key]) if texts else uniform_sample(df, [key])
    if options.compress:
        df = dictionary_encode(df, key)
    return df


def limit_rows(df: DataFrame, key: Sequence[str], max_rows: int | None = None, seed: int = SEED) -> DataFrame:
    """Optional cap before modelling; all rows unless ``max_rows`` is set."""
    return df if max_rows is None else uniform_sample(df, key, max_rows, seed)
