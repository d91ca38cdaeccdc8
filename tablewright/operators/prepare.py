"""From a raw table to model features: typing, filling, encoding, splitting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.quantiles import quantiles
from tablewright.functions.ranking import hashed_row_number
from tablewright.functions.scalars import (
    NUMBER,
    UNKNOWN,
    as_column,
    finite_table,
    is_numeric,
    measure,
    numeric_columns,
    parse_number,
    scalar_sql,
    scalar_table,
    select_existing,
    string_columns,
)
from tablewright.operators.clean import fill_median, fill_mode
from tablewright.operators.profile import fit_modes
from tablewright.operators.roles import column_roles

# Fixed values of feature preparation and splitting.
MAX_CATEGORIES = 100
CLEARLY_MORE = 2  # an estimate beyond so many times the limit settles that a column has too many values
VOTE_SHARE = 0.5
IDENTIFIER_RATIO = 0.95
TEST_SHARE = 0.2
SEED = 42


def fit_votes(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Text columns that are numbers in more than half of all rows."""
    columns = string_columns(df) if columns is None else list(columns)
    if not columns:
        return []
    row = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count(parse_number(c)).alias(f"v{i}") for i, c in enumerate(columns)]
    ).first()
    return [c for i, c in enumerate(columns) if row[f"v{i}"] > VOTE_SHARE * row["_n"]]


def coerce_by_vote(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Turn mostly-numeric text columns into doubles; cells that are not numbers become zero."""
    voted = set(fit_votes(df, columns))
    return df.select(
        *[F.coalesce(parse_number(c), F.lit(0.0)).alias(c) if c in voted else as_column(c) for c in df.columns]
    )


def fit_categories(df: DataFrame, columns: Sequence[str], limit: int = MAX_CATEGORIES) -> dict[str, list[str] | None]:
    """Sorted values of each text column, or None where there are more than ``limit``.

    Columns that one scan estimates at far more values are ruled out first, by a
    margin of many times the estimate's error; only the rest are listed.
    """
    wanted = list(columns)
    if not wanted:
        return {}
    guess = df.agg(*[F.approx_count_distinct(as_column(c), 0.02).alias(f"n{i}") for i, c in enumerate(wanted)]).first()
    columns = [c for i, c in enumerate(wanted) if guess[i] <= CLEARLY_MORE * limit + 10]
    if not columns:
        return dict.fromkeys(wanted)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), as_column(c).alias("value")) for c in columns])
    values = df.select(F.inline(cells)).where(F.col("value").isNotNull()).distinct()
    ranked = values.withColumn("_rn", F.row_number().over(Window.partitionBy("column").orderBy("value")))
    found: dict[str, list[str] | None] = {c: [] for c in columns}
    for row in ranked.where(F.col("_rn") <= limit + 1).collect():
        found[row["column"]].append(row["value"])
    listed = {c: sorted(v) if len(v) <= limit else None for c, v in found.items()}
    return {c: listed.get(c) for c in wanted}


def category_code(c: str | Column, categories: Sequence[str]) -> Column:
    """Position of a value in the sorted list, from 0; null when it is not in it."""
    listed = F.array(*[F.lit(v) for v in categories]) if categories else F.array().cast("array<string>")
    return F.nullif(F.array_position(listed, as_column(c)), F.lit(0)) - 1


def label_encode(df: DataFrame, columns: Sequence[str] | None = None, limit: int = MAX_CATEGORIES) -> DataFrame:
    """Replace text columns with codes in value order; columns with too many values are dropped."""
    columns = string_columns(df) if columns is None else list(columns)
    categories = fit_categories(df, columns, limit)
    return df.select(
        *[
            category_code(c, categories[c]).alias(c) if c in categories else as_column(c)
            for c in df.columns
            if c not in categories or categories[c] is not None
        ]
    )


def one_hot(df: DataFrame, columns: Sequence[str], limit: int = MAX_CATEGORIES) -> DataFrame:
    """One 0/1 column per category except the alphabetically first; wide columns are dropped."""
    categories = fit_categories(df, columns, limit)
    out: list[Column] = []
    for c in df.columns:
        if c not in categories:
            out.append(as_column(c))
        else:
            for v in (categories[c] or [])[1:]:
                out.append(F.coalesce((as_column(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}"))
    return df.select(*out)


def target_codec(df: DataFrame, target: str, code: str, prediction: str, decoded: str):
    """Fitted encoder of the target and the decoder of predicted codes."""
    indexer = StringIndexer(inputCol=target, outputCol=code, stringOrderType="alphabetAsc", handleInvalid="keep").fit(df)
    return indexer, IndexToString(inputCol=prediction, outputCol=decoded, labels=indexer.labels)


def prepare_features(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """All-numeric feature table: drop identifiers, reduce complex cells, fill gaps, encode text."""
    df = select_existing(df, columns) if columns else df
    roles = column_roles(df, exact=exact)
    keys = [
        row["column"]
        for row in roles.where((F.col("role") == "identifier") & (F.col("ratio") > IDENTIFIER_RATIO)).select("column").collect()
    ]
    df = finite_table(scalar_table(df.drop(*keys), texts=True))
    df = fill_median(df, exact=exact)
    df = fill_mode(df, string_columns(df))
    df = label_encode(coerce_by_vote(df))
    numbers = numeric_columns(df)
    if not numbers:
        raise ValueError("no numeric column is left after preparation")
    return df.select(*[F.coalesce(measure(df, c), F.lit(0.0)).alias(c) for c in numbers])


def training_features(df: DataFrame, target: str) -> list[str]:
    """Numeric columns other than the target."""
    names = [c for c in numeric_columns(df) if c != target]
    if not names:
        raise ValueError("no numeric feature")
    return names


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fit_feature_pipeline(
    df: DataFrame, columns: Sequence[str], output: str = "features", exact: bool = True
) -> tuple[PipelineModel, list[str]]:
    """Fitted stages from raw columns to a feature vector, reusable on new rows.

    Arrays, maps, structs and JSON arrays in text become scalars first, by the rules
    of :func:`scalar_cell`. The constants (medians, modes, category codes) are fitted
    once and stored in the pipeline with these rules, so scoring a row never refits them.
    """
    raw = select_existing(df, columns)
    cells = {f.name: scalar_sql(f.name, f.dataType) for f in raw.schema}
    df = finite_table(scalar_table(raw, texts=True))
    numbers = numeric_columns(df)
    texts = string_columns(df)
    medians = quantiles(df, numbers, [0.5], exact)
    modes = fit_modes(df, texts)
    voted = set(fit_votes(df, texts))
    categories = fit_categories(df, [c for c in texts if c not in voted])
    parts, names = [], []
    for c in df.columns:
        name = f"{output}_{len(names)}"
        if c in numbers:
            cell = f"CAST({cells[c]} AS DOUBLE)"
            good = f"IF(isnan({cell}) OR abs({cell}) = double('Infinity'), NULL, {cell})"
            parts.append(f"coalesce({good}, {float(medians[c][0] or 0.0)!r}D) AS {name}")
        elif c in voted:
            text = f"trim(coalesce({cells[c]}, {_literal(modes[c] or UNKNOWN)}))"
            number = f"IF({text} RLIKE {_literal(f'^{NUMBER}$')}, try_cast({text} AS DOUBLE), NULL)"
            parts.append(f"coalesce(IF(abs({number}) = double('Infinity'), NULL, {number}), 0D) AS {name}")
        elif categories.get(c):
            listed = ", ".join(_literal(v) for v in categories[c])
            filled = f"coalesce({cells[c]}, {_literal(modes[c] or UNKNOWN)})"
            parts.append(f"CAST(greatest(array_position(array({listed}), {filled}) - 1, 0) AS DOUBLE) AS {name}")
        else:
            continue
        names.append((c, name))
    if not names:
        raise ValueError("no feature is left after preparation")
    select = SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")
    assemble = VectorAssembler(inputCols=[n for _, n in names], outputCol=output)
    return PipelineModel([select, assemble]), [c for c, _ in names]


def stratified_split(
    df: DataFrame, target: str, key: Sequence[str], test_share: float = TEST_SHARE, seed: int = SEED
) -> DataFrame:
    """Add ``is_test``: the wanted share of every class, chosen by seeded hash of the key."""
    numbered = hashed_row_number(df, [target], key, seed, "_rn", df.count())
    quota = F.round(F.col("_group_size") * F.lit(test_share))
    return numbered.withColumn("is_test", F.col("_rn") <= quota).drop("_rn", "_group_size")


def plain_split(df: DataFrame, key: Sequence[str], test_share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Add ``is_test`` without regard to class."""
    rows = df.count()
    numbered = hashed_row_number(df.withColumn("_all", F.lit(0)), ["_all"], key, seed, "_rn", rows)
    return numbered.withColumn("is_test", F.col("_rn") <= round(rows * test_share)).drop("_rn", "_all", "_group_size")


def adaptive_split(
    df: DataFrame, target: str, key: Sequence[str], test_share: float = TEST_SHARE, seed: int = SEED
) -> DataFrame:
    """Stratify only when classes are few enough: more than one, fewer than half the rows."""
    counts = df.groupBy(as_column(target)).agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("classes"), F.sum("n").alias("rows")
    ).first()
    if 1 < counts["classes"] < 0.5 * (counts["rows"] or 0):
        return stratified_split(df, target, key, test_share, seed)
    return plain_split(df, key, test_share, seed)


def fold_numbers(df: DataFrame, target: str, key: Sequence[str], folds: int = 5, seed: int = SEED) -> DataFrame:
    """Add ``fold``: stratified cross-validation folds, from 0."""
    numbered = hashed_row_number(df, [target], key, seed, "_rn", df.count())
    return numbered.withColumn("fold", F.pmod(F.col("_rn") - 1, F.lit(folds)).cast("int")).drop("_rn", "_group_size")
