"""Scaling, binning, aggregation and frequency hierarchies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.quantiles import quantiles
from tablewright.functions.scalars import as_column, measure, numeric_columns, string_columns
from tablewright.operators.profile import _rows, fit_distinct_within, fit_moments

# Bin labels, hierarchy labels and thresholds.
BIN_LABELS = ("Very Low", "Low", "Medium", "High", "Very High")
HIERARCHY_LABELS = ("Low_Frequency", "Medium_Frequency", "High_Frequency")
BIN_MIN_DISTINCT = 10
GROUP_SHARE = 0.5


@dataclass(frozen=True)
class TransformOptions:
    """Steps of :func:`transform`, applied in this order."""

    normalise: bool = True
    discretise: bool = True
    aggregate: bool = False
    hierarchy: bool = False


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else as_column(c) for c in df.columns])


def zscore(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Centre and scale by the population deviation; constant columns stay as they are."""
    moments = fit_moments(df, columns)
    return _replace(
        df,
        {
            c: (measure(df, c) - F.lit(m["mean"])) / F.lit(m["std_pop"])
            for c, m in moments.items()
            if m["std"] and m["std"] > 0
        },
    )


def zscore_report(df: DataFrame) -> DataFrame:
    """What :func:`zscore` fits: mean, sample deviation and range per scaled column."""
    return _rows(
        df.sparkSession,
        [(c, m["mean"], m["std"], m["min"], m["max"]) for c, m in fit_moments(df).items() if m["std"] and m["std"] > 0],
        "column string, mean double, std double, min double, max double",
    )


def label_by_edges(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins: the label of the first upper edge the value does not exceed."""
    out = F.when(value <= F.lit(float(edges[0])), labels[0])
    for edge, label in zip(edges[1:], labels[1:]):
        out = out.when(value <= F.lit(float(edge)), label)
    return out


def bin_equal_width(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Add ``{column}_discrete``: five equal-width bins of columns with over ten values."""
    columns = numeric_columns(df) if columns is None else list(columns)
    many = fit_distinct_within(df, {c: (BIN_MIN_DISTINCT, float("inf")) for c in columns})
    columns = [c for c in columns if many[c]]
    moments = fit_moments(df, columns)
    n = len(BIN_LABELS)
    added = {}
    for c in columns:
        low, high = moments[c]["min"], moments[c]["max"]
        width = (high - low) / n
        edges = [low + k * width for k in range(1, n)] + [high]
        added[f"{c}_discrete"] = label_by_edges(measure(df, c), edges, BIN_LABELS)
    return df.withColumns(added) if added else df


def bin_equal_frequency(df: DataFrame, column: str, bins: int = 5, exact: bool = True) -> DataFrame:
    """Add ``{column}_bin``: ordinals of bins that hold about the same number of rows."""
    cuts = quantiles(df, [column], [k / bins for k in range(1, bins)], exact)[column]
    v = measure(df, column)
    above = [(v > F.lit(c)).cast("int") for c in cuts if c is not None]
    ordinal = sum(above, F.lit(0))
    return df.withColumn(f"{column}_bin", F.when(v.isNotNull(), ordinal + 1))


def bin_thresholds(df: DataFrame, column: str, thresholds: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """Add ``{column}_band``: right-closed bins at given thresholds, one label more than thresholds."""
    if len(labels) != len(thresholds) + 1:
        raise ValueError("give one label more than thresholds")
    v = measure(df, column)
    band = label_by_edges(v, sorted(thresholds), labels[:-1])
    return df.withColumn(f"{column}_band", F.coalesce(band, F.when(v.isNotNull(), F.lit(labels[-1]))))


def aggregate_by_first_text(df: DataFrame) -> DataFrame | None:
    """Mean, sum and count of every numeric column by the first text column.

    None when there is no such column or it has too many values to summarise.
    """
    texts, numbers = string_columns(df), numeric_columns(df)
    if not texts or not numbers:
        return None
    key = texts[0]
    if not fit_distinct_within(df, {key: (-1, GROUP_SHARE * df.count())})[key]:
        return None
    groups = df.where(as_column(key).isNotNull()).groupBy(as_column(key))
    return groups.agg(
        *[
            f(measure(df, c)).alias(f"{c}_{name}")
            for c in numbers
            for name, f in (("mean", F.avg), ("sum", F.sum), ("count", F.count))
        ]
    )


def aggregate_by(df: DataFrame, keys: Sequence[str], measures: Sequence[str], functions: Sequence[str]) -> DataFrame:
    """Chosen aggregates of chosen columns: sum, mean, count, min, max, std."""
    known = {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max, "std": F.stddev_samp}
    return df.groupBy(*[as_column(k) for k in keys]).agg(
        *[known[f](measure(df, m)).alias(f"{m}_{f}") for m in measures for f in functions]
    )


def frequency_hierarchy(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Add ``{column}_hierarchy``: how common the value is among the column's values."""
    low, high = 5, 50
    columns = string_columns(df) if columns is None else list(columns)
    some = fit_distinct_within(df, {c: (low, high) for c in columns})
    for c in [c for c in columns if some[c]]:
        counts = df.where(as_column(c).isNotNull()).groupBy(as_column(c).alias("_value")).agg(
            F.count(F.lit(1)).alias("_n")
        )
        cuts = counts.agg(F.percentile("_n", [0.33, 0.67])).first()[0]
        level = (
            F.when(F.col("_n") >= cuts[1], HIERARCHY_LABELS[2])
            .when(F.col("_n") >= cuts[0], HIERARCHY_LABELS[1])
            .otherwise(HIERARCHY_LABELS[0])
        )
        # fewer than fifty rows, as checked above
        lookup = F.broadcast(counts.select("_value", level.alias(f"{c}_hierarchy")))
        df = (
            df.join(lookup, as_column(c) == F.col("_value"), "left")
            .drop("_value")
            .withColumn(f"{c}_hierarchy", F.coalesce(F.col(f"`{c}_hierarchy`"), F.lit(HIERARCHY_LABELS[0])))
        )
    return df


def scale_to_hundred(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Min-max scale to 0-100; null counts as zero, a constant column becomes 50."""
    moments = fit_moments(df, columns)
    new = {}
    for c, m in moments.items():
        low, high = m["min"], m["max"]
        if low is None or not high > low:
            new[c] = F.lit(50.0)
        else:
            new[c] = (F.coalesce(measure(df, c), F.lit(0.0)) - F.lit(low)) / F.lit(high - low) * 100
    return _replace(df, new)


def robust_scale(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Centre on the median and scale by the interquartile range; null if that is zero."""
    columns = numeric_columns(df) if columns is None else list(columns)
    cuts = quantiles(df, columns, [0.25, 0.5, 0.75], exact)
    return _replace(
        df,
        {
            c: (measure(df, c) - F.lit(median).cast("double")) / F.lit((q3 - q1) or None if q1 is not None else None).cast("double")
            for c, (q1, median, q3) in cuts.items()
        },
    )


def transform(df: DataFrame, options: TransformOptions = TransformOptions()) -> tuple[DataFrame, DataFrame | None]:
    """Apply the chosen steps in order; returns the table and the aggregate, if one was asked for."""
    if options.normalise:
        df = zscore(df)
    if options.discretise:
        df = bin_equal_width(df)
    summary = aggregate_by_first_text(df) if options.aggregate else None
    if options.hierarchy:
        df = frequency_hierarchy(df)
    return df, summary
