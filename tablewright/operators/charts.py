"""Tables behind charts: series, histograms, slices, radar axes and chart suggestions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.quantiles import quantiles
from tablewright.functions.scalars import as_column, measure, numeric_columns, parse_number
from tablewright.operators.profile import IQR_FACTOR, _long_stats, _rows, fit_moments
from tablewright.operators.roles import role_counts
from tablewright.operators.transform import scale_to_hundred

# The chart catalog, as category, chart and what a table must offer.
CHARTS = (
    ("comparison", "bar", ("categorical", "numeric")),
    ("comparison", "line", ("numeric", "time")),
    ("comparison", "column", ("categorical", "numeric")),
    ("comparison", "radar", ("numeric",)),
    ("comparison", "wordcloud", ("categorical",)),
    ("distribution", "histogram", ("numeric",)),
    ("distribution", "boxplot", ("numeric",)),
    ("distribution", "density", ("numeric",)),
    ("distribution", "violin", ("numeric",)),
    ("composition", "pie", ("categorical",)),
    ("composition", "treemap", ("categorical", "hierarchical")),
    ("composition", "multiset", ("categorical",)),
    ("composition", "area", ("numeric", "time")),
    ("composition", "stackedbar", ("categorical",)),
    ("composition", "sunburst", ("hierarchical",)),
    ("composition", "waterfall", ("numeric",)),
    ("relationship", "scatter", ("numeric",)),
    ("relationship", "bubble", ("numeric",)),
    ("relationship", "geospatial", ("geographic",)),
    ("relationship", "heatmap", ("numeric",)),
    ("relationship", "network", ("relational",)),
)
# Name hints and sizes of chart tables.
TIME_HINT = r"date|time|year"
GEO_HINT = r"lat|lng|location|city"
SERIES_ROWS = 50
RADAR_ROWS, RADAR_AXES = 10, 6
SNIFF_ROWS = 10
SCATTER_ROWS = 200
HISTOGRAM_BINS = 10


def suitable_charts(roles: DataFrame) -> DataFrame:
    """Charts of the catalog that the table's column roles support."""
    name = F.lower("column")
    hints = roles.agg(
        F.bool_or(name.rlike(TIME_HINT)).alias("time"), F.bool_or(name.rlike(GEO_HINT)).alias("geographic")
    )
    counts = role_counts(roles).agg(
        F.sum(F.when(F.col("role") == "numeric", F.col("n_columns"))).alias("n_numeric"),
        F.sum(F.when(F.col("role") == "categorical", F.col("n_columns"))).alias("n_categorical"),
        F.sum(F.when(F.col("role") == "binary", F.col("n_columns"))).alias("n_binary"),
    )
    # both sides are a single row
    facts = counts.crossJoin(hints).select(
        F.map_from_arrays(
            F.array(*[F.lit(k) for k in ("numeric", "categorical", "time", "geographic", "hierarchical", "relational")]),
            F.array(
                F.col("n_numeric") > 0,
                (F.col("n_categorical") > 0) | (F.col("n_binary") > 0),
                F.col("time"),
                F.col("geographic"),
                F.col("n_categorical") > 1,
                F.col("n_numeric") >= 2,
            ),
        ).alias("offers")
    )
    options = F.array(
        *[
            F.struct(
                F.lit(category).alias("category"),
                F.lit(chart).alias("chart"),
                F.array(*[F.lit(n) for n in needs]).alias("needs"),
            )
            for category, chart, needs in CHARTS
        ]
    )
    listed = facts.select("offers", F.inline(options))
    return listed.where(F.exists("needs", lambda n: F.col("offers")[n])).select("category", "chart")


def xy_series(df: DataFrame, x: str, y: str, order_by: str, rows: int = SERIES_ROWS) -> DataFrame:
    """The first rows as points: null x dropped, null y as zero."""
    value = F.coalesce(measure(df, y), F.lit(0.0)) if y in numeric_columns(df) else as_column(y)
    return (
        df.orderBy(as_column(order_by))
        .limit(rows)
        .where(as_column(x).isNotNull())
        .select(as_column(order_by).alias("key"), as_column(x).alias("x"), value.alias("y"))
    )


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS, drop_max: bool = False) -> DataFrame:
    """Counts in equal left-closed bins, empty ones included.

    The last bin is closed on both sides; ``drop_max`` leaves the maximum out.
    """
    m = fit_moments(df, [column])[column]
    labels = []
    if m["count"]:
        low, width = m["min"], (m["max"] - m["min"]) / bins
        labels = [(i, f"{low + i * width:.1f}-{low + i * width + width:.1f}") for i in range(bins)]
    frame = _rows(df.sparkSession, labels, "bin int, label string")
    if not labels:
        return frame.withColumn("count", F.lit(0).cast("long"))
    v = measure(df, column)
    starts = [low + i * width for i in range(bins)]
    # comparing with the starts keeps edge values where the labels say they are
    index = sum([(v >= F.lit(s)).cast("int") for s in starts[1:]], F.lit(0))
    kept = df.where(v.isNotNull())
    if drop_max:
        kept = kept.where(v < F.lit(starts[-1] + width))
    counts = kept.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return frame.join(counts, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def pie(df: DataFrame, column: str) -> DataFrame:
    """Rows per value; missing values are a slice of their own."""
    name = F.coalesce(as_column(column).cast("string"), F.lit("null")).alias("name")
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("value"))


def radar(df: DataFrame, order_by: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The first rows on up to six numeric axes, each scaled to 0-100 over the whole table."""
    axes = list(columns or numeric_columns(df))[:RADAR_AXES]
    keep = df.select(as_column(order_by).alias("_key"), *[as_column(c) for c in axes])
    scaled = scale_to_hundred(keep, axes).orderBy("_key").limit(RADAR_ROWS)
    # halves round up
    return scaled.select(F.col("_key").alias("key"), *[F.floor(as_column(c) + 0.5).cast("long").alias(c) for c in axes])


def looks_numeric(df: DataFrame, order_by: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Whether the present values among a table's first rows all start with a number."""
    columns = list(columns or df.columns)
    head = df.orderBy(as_column(order_by)).limit(SNIFF_ROWS).select(
        *[as_column(c).cast("string").alias(c) for c in columns]
    )

    def metrics(c: str) -> list[Column]:
        bad = F.count_if(as_column(c).isNotNull() & parse_number(c, lenient=True).isNull())
        return [((F.count(as_column(c)) > 0) & (bad == 0)).alias("is_numeric")]

    return _long_stats(head, columns, metrics)


def first_points(df: DataFrame, order_by: str, rows: int = SCATTER_ROWS) -> DataFrame:
    """The first rows of a labelled table, for a scatter of clusters or anomalies."""
    return df.orderBy(as_column(order_by)).limit(rows)


def box_plot(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Five numbers, fences and the count of points beyond them."""
    columns = numeric_columns(df) if columns is None else list(columns)
    cuts = quantiles(df, columns, [0.25, 0.5, 0.75], exact)

    def metrics(c: str) -> list[Column]:
        q1, median, q3 = (F.lit(q).cast("double") for q in cuts[c])
        v = measure(df, c)
        low, high = q1 - IQR_FACTOR * (q3 - q1), q3 + IQR_FACTOR * (q3 - q1)
        return [
            F.min(v).alias("min"),
            q1.alias("q1"),
            median.alias("median"),
            q3.alias("q3"),
            F.max(v).alias("max"),
            F.min(F.when(v >= low, v)).alias("whisker_low"),
            F.max(F.when(v <= high, v)).alias("whisker_high"),
            F.count_if((v < low) | (v > high)).alias("n_outliers"),
        ]

    return _long_stats(df, columns, metrics)


def stacked_bar(df: DataFrame, x: str, stack: str) -> DataFrame:
    """Rows per pair of categories."""
    return df.groupBy(as_column(x).alias("x"), as_column(stack).alias("stack")).agg(F.count(F.lit(1)).alias("count"))


def word_counts(df: DataFrame, column: str) -> DataFrame:
    """Occurrences of each lower-cased word; words are split at white space."""
    words = F.explode(F.split(F.lower(as_column(column)), r"\s+")).alias("word")
    return df.select(words).where(F.col("word") != "").groupBy("word").agg(F.count(F.lit(1)).alias("count"))
