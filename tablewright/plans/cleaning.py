"""The cleaning chain: missing values, duplicates, outliers, then optional steps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.scalars import finite_table, string_columns
from tablewright.operators import clean as C
from tablewright.operators.quality import quality_report, quality_score
from tablewright.operators.reduce import ReduceOptions, dictionaries, reduce_table, reduction_summary
from tablewright.operators.transform import TransformOptions, transform


@dataclass(frozen=True)
class CleanOptions:
    """What to do at each step.

    missing: remove_rows, fill_mean, fill_median, fill_mode, fill_zero, forward_fill, keep
    duplicates: remove, keep_first, keep_last, keep
    outliers: remove, cap, z_score, keep
    """

    missing: str = "fill_mean"
    duplicates: str = "remove"
    outliers: str = "keep"
    transform: TransformOptions | None = None
    reduce: ReduceOptions | None = None
    key: str | None = None  # row key, for forward fill, keep_first/keep_last, sampling and encoding
    group: str | None = None  # entity whose rows a forward fill follows, or whose first/last row is kept
    exact: bool = True


def _missing(df: DataFrame, options: CleanOptions) -> DataFrame:
    if options.missing == "remove_rows":
        return C.drop_missing(df)
    if options.missing == "fill_mean":
        return C.fill_mean(df)
    if options.missing == "fill_median":
        return C.fill_mode(C.fill_median(df, exact=options.exact), string_columns(df))
    if options.missing == "fill_mode":
        return C.fill_mode(df)
    if options.missing == "fill_zero":
        return C.fill_zero(df)
    if options.missing == "forward_fill":
        if not options.key or not options.group:
            raise ValueError("forward_fill needs key and group")
        return C.forward_fill(df, options.group, options.key, [c for c in df.columns if c not in (options.key, options.group)])
    if options.missing == "keep":
        return df
    raise ValueError(f"unknown missing-value strategy {options.missing!r}")


def _duplicates(df: DataFrame, options: CleanOptions) -> DataFrame:
    if options.duplicates == "remove":
        return C.drop_duplicates(df)
    if options.duplicates in ("keep_first", "keep_last"):
        if not options.key or not options.group:
            raise ValueError(f"{options.duplicates} needs key and group")
        return C.keep_one(df, [options.group], options.key, options.duplicates.removeprefix("keep_"))
    if options.duplicates == "keep":
        return df
    raise ValueError(f"unknown duplicate strategy {options.duplicates!r}")


def _outliers(df: DataFrame, options: CleanOptions) -> DataFrame:
    if options.outliers == "remove":
        return C.remove_outliers(df, exact=options.exact)
    if options.outliers == "cap":
        return C.cap_outliers(df, exact=options.exact)
    if options.outliers == "z_score":
        return C.remove_z_outliers(df)
    if options.outliers == "keep":
        return df
    raise ValueError(f"unknown outlier strategy {options.outliers!r}")


@dataclass(frozen=True)
class CleanRun:
    """A cleaned table with everything that is reported about the run.

    before, after: all findings of the quality report, by name.
    aggregate: the table of group measures, if that step was chosen.
    reduction: size before and after the reduction steps, if there were any.
    dictionaries: value and code of every encoded column.
    """

    table: DataFrame
    before: dict[str, DataFrame]
    after: dict[str, DataFrame]
    aggregate: DataFrame | None
    reduction: DataFrame | None
    dictionaries: dict[str, DataFrame]


def _steps(df: DataFrame, options: CleanOptions) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """The cleaned table, the aggregate, and the table as it was before reduction."""
    aggregate = None
    df = _outliers(_duplicates(_missing(finite_table(df), options), options), options)
    if options.transform:
        df, aggregate = transform(df, options.transform)
    whole = df
    if options.reduce:
        if not options.key:
            raise ValueError("reduction needs key")
        df = reduce_table(df, options.key, options.reduce)
    return df, aggregate, whole


def clean(df: DataFrame, options: CleanOptions = CleanOptions()) -> DataFrame:
    """Apply the chosen steps in order. Jobs run only for the constants a step fits."""
    return _steps(df, options)[0]


def clean_with_reports(df: DataFrame, options: CleanOptions = CleanOptions()) -> CleanRun:
    """Apply the chosen steps and report on the table before and after them."""
    table, aggregate, whole = _steps(df, options)
    return CleanRun(
        table,
        quality_report(df),
        quality_report(table),
        aggregate,
        reduction_summary(whole, table) if options.reduce else None,
        dictionaries(whole, table) if options.reduce and options.reduce.compress else {},
    )


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows, missing cells, duplicates and quality score, before and after."""
    stages = [
        quality_score(df).select(
            F.lit(name).alias("stage"),
            F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
            F.coalesce("missing_cells", F.lit(0)).alias("missing_cells"),
            F.coalesce("duplicates", F.lit(0)).alias("duplicates"),
            "score",
        )
        for name, df in (("before", before), ("after", after))
    ]
    return stages[0].unionByName(stages[1])


def preview(df: DataFrame, options: CleanOptions = CleanOptions()) -> DataFrame:
    """What cleaning would change, in one row; nothing is saved."""
    stages = compare(df, clean(df, options))

    def at(stage: str, name: str):
        return F.max(F.when(F.col("stage") == stage, F.col(name)))

    return stages.agg(
        at("before", "n_rows").alias("rows_before"),
        at("after", "n_rows").alias("rows_after"),
        at("before", "missing_cells").alias("missing_before"),
        at("after", "missing_cells").alias("missing_after"),
        at("before", "duplicates").alias("duplicates_before"),
        at("after", "duplicates").alias("duplicates_after"),
        (at("before", "n_rows") - at("after", "n_rows")).alias("rows_removed"),
    )
