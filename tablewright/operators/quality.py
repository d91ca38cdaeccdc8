"""Data-quality findings derived from the profile, and the reports that combine them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.scalars import as_column, finite, measure, numeric_columns, row_key, string_columns
from tablewright.operators import profile as P

# Thresholds of the report.
LOW_VARIANCE = 0.01
WIDE_RANGE = 1000
WIDE_STD = 100
MANY_VALUES = 20
HIERARCHY_RANGE = (5, 50)
AGGREGATION_SHARE = 0.3
FUSION_SHARE = 0.5
SAMPLING_FLOOR = 10_000
SAMPLE_SIZE = 5_000


class _Facts:
    """What several findings of one table are derived from; each is fitted when it is first read."""

    def __init__(self, df: DataFrame):
        self.df = df

    @cached_property
    def numbers(self) -> tuple[dict[str, dict], dict[str, list[float | None]]]:
        """Moments and quartiles of the numeric columns."""
        return P.moments_and_quantiles(self.df, numeric_columns(self.df), P.QUARTILES)

    @cached_property
    def moments(self) -> dict[str, dict]:
        return self.numbers[0]

    @cached_property
    def rows(self) -> int:
        """Rows of the table; numeric columns know it without another scan."""
        if known := "numbers" in self.__dict__ and next(iter(self.moments.values()), None):
            return known["count"] + known["nulls"]
        return self.df.count()

    @cached_property
    def distinct(self) -> dict[str, int]:
        """Distinct values of every numeric and text column."""
        return P.fit_distinct(self.df, numeric_columns(self.df) + string_columns(self.df))

    @cached_property
    def columns(self) -> dict[str, dict]:
        """Missing cells and outliers of each column, from one scan."""
        df, quartiles = self.df, self.numbers[1]
        numbers = set(numeric_columns(df))
        fences = {c: P._fence(quartiles[c][0], quartiles[c][2]) for c in numbers}

        def metrics(c: str) -> list[Column]:
            low, high = fences.get(c) or (None, None)
            v = measure(df, c) if c in numbers else F.lit(None).cast("double")
            beyond = (v < F.lit(low).cast("double")) | (v > F.lit(high).cast("double"))
            return [F.count_if(_is_missing(df, c)).alias("n_missing"), F.count_if(beyond).alias("n_outliers")]

        return {r["column"]: r.asDict() for r in P._long_stats(df, df.columns, metrics).collect()}

    def counted(self, columns: list[str], low: float, high: float) -> DataFrame:
        """``(column, n_distinct)`` of the columns with a number of values between the bounds."""
        found = [(c, self.distinct[c]) for c in columns if low < self.distinct[c] < high]
        return P._rows(self.df.sparkSession, found, "column string, n_distinct long")


def variance_bands(df: DataFrame, moments: dict[str, dict] | None = None) -> DataFrame:
    """Sample variance of numeric columns, banded low or high."""
    moments = P.fit_moments(df) if moments is None else moments
    return P._rows(
        df.sparkSession,
        [(c, m["var"], "low" if m["var"] is not None and m["var"] < LOW_VARIANCE else "high") for c, m in moments.items()],
        "column string, variance double, band string",
    )


def cell_bytes(df: DataFrame, name: str) -> Column:
    """Encoded size of a cell: fixed width, or the bytes of its text."""
    data_type = df.schema[name].dataType
    fixed = {
        T.ByteType: 1,
        T.BooleanType: 1,
        T.ShortType: 2,
        T.IntegerType: 4,
        T.FloatType: 4,
        T.DateType: 4,
    }
    if isinstance(data_type, T.StringType):
        return F.coalesce(F.octet_length(as_column(name)), F.lit(0)).cast("long")
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(as_column(name))), F.lit(0)).cast("long")
    return F.lit(fixed.get(type(data_type), 8)).cast("long")


def table_shape(df: DataFrame) -> DataFrame:
    """Declared type, rows and encoded bytes of each column."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return P._long_stats(
        df,
        df.columns,
        lambda c: [
            F.lit(types[c]).alias("dtype"),
            F.count(F.lit(1)).alias("n_rows"),
            F.coalesce(F.sum(cell_bytes(df, c)), F.lit(0)).alias("n_bytes"),
        ],
    )


def normalisation_candidates(df: DataFrame, moments: dict[str, dict] | None = None) -> DataFrame:
    """Numeric columns with a wide range or a large deviation."""
    moments = P.fit_moments(df) if moments is None else moments
    table = P._rows(
        df.sparkSession,
        [(c, m["max"] - m["min"], m["std"]) for c, m in moments.items() if m["count"]],
        "column string, value_range double, std double",
    )
    return table.where((F.col("value_range") > WIDE_RANGE) | (F.col("std") > WIDE_STD))


NO_BOUND = float("inf")


def discretisation_candidates(df: DataFrame) -> DataFrame:
    """Numeric columns with many distinct values."""
    return P.distinct_counts_within(df, numeric_columns(df), MANY_VALUES, NO_BOUND)


def hierarchy_candidates(df: DataFrame) -> DataFrame:
    """Text columns with a moderate number of categories."""
    return P.distinct_counts_within(df, string_columns(df), *HIERARCHY_RANGE)


def _with_measures(found: DataFrame, df: DataFrame) -> DataFrame:
    measures = numeric_columns(df)
    return found.withColumn("measures", F.lit(",".join(measures))).where(F.lit(bool(measures)))


def aggregation_opportunities(df: DataFrame) -> DataFrame:
    """Text columns worth grouping by, with the numeric columns to aggregate."""
    return _with_measures(P.distinct_counts_within(df, string_columns(df), -1, AGGREGATION_SHARE * df.count()), df)


def fusion_suggestions(df: DataFrame) -> DataFrame:
    """Text columns distinct enough to match records of another table on."""
    return P.distinct_counts_within(df, string_columns(df), FUSION_SHARE * df.count(), NO_BOUND)


def sampling_recommendation(df: DataFrame) -> DataFrame:
    """Suggested sample size; no row when the table is small."""
    size = F.least(F.lit(SAMPLE_SIZE).cast("long"), F.col("n_rows"))
    return (
        df.agg(F.count(F.lit(1)).alias("n_rows"))
        .where(F.col("n_rows") > SAMPLING_FLOOR)
        .select("n_rows", size.alias("sample_size"), (size / F.col("n_rows")).alias("sampling_ratio"))
    )


def duplicate_records(df: DataFrame) -> DataFrame:
    """Rows that share all their text columns with another row, every member counted."""
    groups = df.groupBy(*row_key(df, string_columns(df))).agg(F.count(F.lit(1)).alias("n"))
    repeated = F.col("n") > 1
    return groups.agg(
        F.count_if(repeated).alias("n_groups"), F.coalesce(F.sum(F.when(repeated, F.col("n"))), F.lit(0)).alias("n_records")
    )


def _is_missing(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return finite(name).isNull()
    return as_column(name).isNull()


def quality_score(df: DataFrame) -> DataFrame:
    """One minus missing cells and duplicate rows per row; negative on very dirty tables."""
    missing = reduce(lambda a, b: a + b, [_is_missing(df, c).cast("int") for c in df.columns])
    groups = df.groupBy(*row_key(df)).agg(F.count(F.lit(1)).alias("n"), F.sum(missing).alias("missing"))
    total = F.sum("n")
    return groups.agg(
        total.alias("n_rows"),
        F.sum("missing").alias("missing_cells"),
        F.sum(F.col("n") - 1).alias("duplicates"),
    ).withColumn("score", 1 - (F.col("missing_cells") + F.col("duplicates")) / F.nullif("n_rows", F.lit(0)))


def complete_row_share(df: DataFrame) -> DataFrame:
    """Share of rows without any missing cell."""
    complete = reduce(lambda a, b: a & b, [~_is_missing(df, c) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(complete.cast("double")).alias("complete_share"))


def simple_report(df: DataFrame) -> DataFrame:
    """One row per numeric or text column: counts, moments or top value, missing cells, outliers."""
    columns = [c for c in df.columns if c in set(numeric_columns(df) + string_columns(df))]
    profile = P.column_profile(df, columns)
    outliers = P.iqr_outliers(df).select("column", "n_outliers")
    categorical = F.col("kind") == "string"
    return profile.join(outliers, "column", "left").select(
        "column",
        F.when(categorical, "categorical").otherwise("numeric").alias("type"),
        (F.col("n_rows") - F.col("n_missing")).alias("count"),
        "n_missing",
        "n_distinct",
        "mean",
        "std",
        "min",
        "max",
        F.when(categorical, F.col("mode")).alias("top"),
        F.when(categorical, F.col("mode_count")).alias("freq"),
        "n_outliers",
    )


class QualityReport(Mapping):
    """All findings, by name. A part is built when it is first read, from facts that the parts share."""

    def __init__(self, df: DataFrame):
        from tablewright.operators import roles as R

        facts = self.facts = _Facts(df)
        texts, numbers = string_columns(df), numeric_columns(df)
        self._built: dict[str, DataFrame] = {}
        self._parts: dict[str, Callable[[], DataFrame]] = {
            "shape": lambda: table_shape(df),
            "roles": lambda: R.column_roles(df),
            "role_counts": lambda: R.role_counts(self["roles"]),
            "missing": lambda: P.missing_counts(df),
            "duplicates": lambda: P.duplicate_rows(df),
            "duplicate_records": lambda: duplicate_records(df),
            "describe": lambda: P.describe(df, numbers, facts.numbers),
            "outliers": lambda: P.iqr_outliers(df, numbers, quartiles=facts.numbers[1]),
            "top_values": lambda: P.top_values(df),
            "variance": lambda: variance_bands(df, facts.moments),
            "high_correlations": lambda: P.high_correlations(df),
            "normalisation_candidates": lambda: normalisation_candidates(df, facts.moments),
            "discretisation_candidates": lambda: facts.counted(numbers, MANY_VALUES, NO_BOUND),
            "hierarchy_candidates": lambda: facts.counted(texts, *HIERARCHY_RANGE),
            "aggregation_opportunities": lambda: _with_measures(facts.counted(texts, -1, AGGREGATION_SHARE * facts.rows), df),
            "fusion_suggestions": lambda: facts.counted(texts, FUSION_SHARE * facts.rows, NO_BOUND),
            "sampling": lambda: sampling_recommendation(df),
        }

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._parts[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._parts)

    def __len__(self) -> int:
        return len(self._parts)


def quality_report(df: DataFrame) -> QualityReport:
    """All findings, by name; each is computed only if it is read."""
    return QualityReport(df)


def findings(df: DataFrame) -> DataFrame:
    """The report's column-level findings in long form: one row per finding.

    Three fits serve all of them: moments with quartiles, distinct values, and one scan for missing cells and outliers.
    """
    parts = quality_report(df)
    facts = parts.facts
    named = {
        "normalise": ("normalisation_candidates", "std"),
        "discretise": ("discretisation_candidates", "n_distinct"),
        "build_hierarchy": ("hierarchy_candidates", "n_distinct"),
        "aggregate_by": ("aggregation_opportunities", "n_distinct"),
        "match_records": ("fusion_suggestions", "n_distinct"),
    }
    found = [("outliers", c, r["n_outliers"]) for c, r in facts.columns.items() if r["n_outliers"]]
    found += [("missing", c, r["n_missing"]) for c, r in facts.columns.items() if r["n_missing"]]
    found += [("low_variance", c, m["var"]) for c, m in facts.moments.items() if m["var"] is not None and m["var"] < LOW_VARIANCE]
    rest = P._rows(df.sparkSession, [(c, kind, float(x)) for kind, c, x in found], "column string, finding string, measure double")
    tables = [
        parts[source].select("column", F.lit(kind).alias("finding"), F.col(metric).cast("double").alias("measure"))
        for kind, (source, metric) in named.items()
    ]
    return reduce(DataFrame.unionByName, [*tables, rest])
