"""Semantic role of every column, from its profile and its name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.quantiles import quantiles
from tablewright.functions.scalars import as_column, string_columns
from tablewright.operators.profile import _long_stats, _rows, column_profile, top_values

# Name patterns and word lists of the role rules.
IDENTIFIER_NAME = r"id$|^id|_id$|^id_|no$|^no|number$|^number"
FOREIGN_KEY_NAME = r"_id$|^id_|code$|^code|ref$|^ref|key$|^key|partner.*id|store.*id|customer.*id"
DATE_NAME = r"date|time|created|updated|delivery|timestamp|datetime"
MONETARY_NAME = r"price|amount|total|balance|income|cost|salary"
MEASURED_NAME = r"age|year|count|quantity|weight|height"
RATIO_NAME = r"percent|rate|ratio|score"
ORDINAL_WORDS = r"low|medium|high|small|large|good|better|best"
YES_NO = ("yes", "no", "y", "n")
TRUE_FALSE = ("true", "false", "t", "f")
GENDER = ("male", "female", "m", "f")
STATUS = ("active", "inactive")

ROLES = ("numeric", "categorical", "binary", "date", "string", "identifier", "foreign_key")

RECOMMENDATION = {
    "numeric": "use in calculations and as a model feature",
    "categorical": "encode before modelling",
    "binary": "encode as 0 and 1",
    "date": "derive year, month and day",
    "string": "derive text features",
    "identifier": "leave out of model features",
    "foreign_key": "encode if needed, or use to look up another table",
}


def binary_subtype(first: str | Column, second: str | Column) -> Column:
    """Kind of a two-valued column; the tests apply in this order."""
    values = [F.lower(as_column(v)) for v in (first, second)]

    def some(words: Sequence[str]) -> Column:
        return values[0].isin(*words) | values[1].isin(*words)

    numbers = [v.try_cast("double") for v in values]
    return (
        F.when(numbers[0].isin(0.0, 1.0) & numbers[1].isin(0.0, 1.0), "numeric_binary")
        .when(some(YES_NO), "yes_no")
        .when(some(TRUE_FALSE), "true_false")
        .when(some(GENDER), "gender")
        .when(some(STATUS), "status")
        .otherwise("custom_binary")
    )


def physical_kind(profile: DataFrame) -> Column:
    """Refine string columns into Categorical, Boolean or Text."""
    two_valued = F.col("n_distinct") == 2
    words = ("yes", "no", "true", "false")
    boolean = two_valued & F.lower("first_value").isin(*words) & F.lower("last_value").isin(*words)
    return (
        F.when(F.col("kind") == "numeric", "Numeric")
        .when(F.col("kind") == "boolean", "Boolean")
        .when(F.col("kind") == "datetime", "DateTime")
        .when((F.col("kind") == "string") & boolean, "Boolean")
        .when(
            (F.col("kind") == "string") & (F.col("n_distinct") <= 50) & ((F.col("ratio") < 0.5) | two_valued),
            "Categorical",
        )
        .when(F.col("kind") == "string", "Text")
        .otherwise("Unsupported")
    )


def _rich(profile: DataFrame) -> DataFrame:
    name = F.lower(F.trim("column"))
    kind, ratio, distinct = F.col("physical"), F.col("ratio"), F.col("n_distinct")
    has_id, has_key, has_date = name.rlike(IDENTIFIER_NAME), name.rlike(FOREIGN_KEY_NAME), name.rlike(DATE_NAME)
    number, category, text = kind == "Numeric", kind == "Categorical", kind == "Text"
    # the date name applies to columns no earlier rule has claimed
    date = (kind == "DateTime") | (has_date & ~kind.isin("Numeric", "Categorical"))
    open_kind = ~kind.isin("Numeric", "Categorical", "DateTime", "Text", "Boolean") & ~has_date
    unique_id = (ratio > 0.95) & has_id
    role = (
        F.when(number & unique_id, "identifier")
        .when(number & has_key & (ratio > 0.01) & (ratio < 0.8), "foreign_key")
        .when(number, "numeric")
        .when(category & (distinct == 2), "binary")
        .when(category, "categorical")
        .when(date, "date")
        .when(text & (F.col("is_url") | F.col("is_email") | (F.col("avg_length") > 50)), "string")
        .when(text, "categorical")
        .when(kind == "Boolean", "binary")
        .when(open_kind & unique_id, "identifier")
        .when(open_kind & (distinct == 2), "binary")
        .otherwise("categorical")
    )
    subtype = (
        F.when(number & (F.col("role") == "identifier"), F.when(ratio == 1.0, "primary_key").otherwise("unique_identifier"))
        .when(F.col("role") == "foreign_key", "foreign_key")
        .when(
            F.col("role") == "numeric",
            F.when(name.rlike(MONETARY_NAME), "monetary")
            .when(name.rlike(MEASURED_NAME), "measured_value")
            .when(name.rlike(RATIO_NAME), "percentage_or_ratio")
            .otherwise("continuous"),
        )
        .when(category & (F.col("role") == "binary"), binary_subtype("first_value", "last_value"))
        .when(
            category,
            F.when(distinct <= 10, "low_cardinality").when(distinct <= 50, "moderate_cardinality").otherwise("high_cardinality"),
        )
        .when(F.col("role") == "date", F.col("date_format"))
        .when(F.col("role") == "string", F.when(F.col("is_url"), "url").when(F.col("is_email"), "email").otherwise("long_text"))
        .when(text, "text_based")
        .when(kind == "Boolean", "boolean")
        .when(F.col("role") == "identifier", "unique_identifier")
        .when(F.col("role") == "binary", "unknown_binary")
        .otherwise("unknown")
    )
    confidence = (
        F.when(number & (F.col("role") == "identifier"), F.least(F.lit(0.95), ratio + 0.05))
        .when(F.col("role") == "identifier", ratio)
        .when(F.col("role") == "foreign_key", F.lit(0.9))
    )
    return profile.withColumn("role", role).withColumn("subtype", subtype).withColumn("confidence", confidence)


def _simple(profile: DataFrame) -> DataFrame:
    kind, ratio, distinct = F.col("kind"), F.col("ratio"), F.col("n_distinct")
    number, text = kind == "numeric", kind.isin("string", "complex")
    role = (
        F.when(number & (ratio > 0.95), "identifier")
        .when(number & (distinct == 2), "binary")
        .when(number, "numeric")
        .when(text & (distinct == 2), "binary")
        .when(text & (ratio > 0.95), "identifier")
        .when(text & (distinct <= 50), "categorical")
        .when(text, "string")
        .when(kind == "boolean", "binary")
        .otherwise("date")
    )
    subtype = (
        F.when(number & (F.col("role") == "identifier"), "unique_identifier")
        .when(number & (F.col("role") == "binary"), "numeric_binary")
        .when(number, "continuous")
        .when(text & (F.col("role") == "binary"), "string_binary")
        .when(text & (F.col("role") == "identifier"), "string_identifier")
        .when(F.col("role") == "categorical", "low_cardinality")
        .when(F.col("role") == "string", "text")
        .when(kind == "boolean", "boolean")
        .otherwise("datetime")
    )
    confidence = F.when(F.col("role") == "identifier", ratio)
    return profile.withColumn("role", role).withColumn("subtype", subtype).withColumn("confidence", confidence)


# Marks that tell the format of a date, the first that fits.
FORMATS = (("T", "ISO_8601"), ("/", "MM/DD/YYYY_or_DD/MM/YYYY"), ("-", "YYYY-MM-DD"))


def _sniffed(df: DataFrame, columns: Sequence[str], order_by: str | None, k: int = 3) -> DataFrame:
    """``(column, date_format, has_time, url, email)`` of each column.

    One scan counts the values that hold each mark. A format, or a time of day, needs half of the present values. With
    ``order_by`` one of the first ``k`` present values is enough.
    """
    schema = "column string, date_format string, has_time boolean, url boolean, email boolean"
    if not columns:
        return _rows(df.sparkSession, [], schema)

    def holds(c: str) -> list[Column]:
        text = as_column(c).cast("string")
        tests = [text.contains(mark) for mark, _ in FORMATS]
        tests += [text.contains(":"), text.contains("http") | text.contains("www."), text.contains("@") & text.contains(".")]
        return [F.count(text).alias("n"), *[F.count_if(t).alias(f"t{i}") for i, t in enumerate(tests)]]

    if order_by:
        firsts = [df.where(as_column(c).isNotNull()).orderBy(order_by).limit(k) for c in columns]
        counted = [first.agg(*holds(c)).first() for c, first in zip(columns, firsts)]
    else:
        counted = sorted(_long_stats(df, columns, holds).collect(), key=lambda r: columns.index(r["column"]))  # a row per column
    records = []
    for c, row in zip(columns, counted):
        enough = 1 if order_by else max(1, row["n"] / 2)
        found = [row[f"t{i}"] >= enough for i in range(len(FORMATS) + 3)]
        label = next((label for (_, label), hit in zip(FORMATS, found) if hit), "unknown")
        records.append((c, label, *found[len(FORMATS) :]))
    return _rows(df.sparkSession, records, schema)


def column_roles(
    df: DataFrame, rules: str = "rich", order_by: str | None = None, exact: bool = True
) -> DataFrame:
    """One role per column, with the counts the rule was based on.

    ``rules="rich"`` looks at names and values, ``rules="simple"`` at types and
    distinct counts only. URL and e-mail columns and date formats are those that
    at least half the values match; with ``order_by`` the first three values
    decide instead. ``exact=False`` estimates distinct counts and leaves
    ``n_singleton`` null.
    """
    profile = column_profile(df, exact=exact)
    if not exact:
        profile = profile.withColumn("n_singleton", F.lit(None).cast("long"))
    profile = profile.withColumn("physical", physical_kind(profile))
    temporal = [f.name for f in df.schema if f.dataType.simpleString() in ("date", "timestamp", "timestamp_ntz")]
    named = [c for c in string_columns(df) if any(w in c.lower() for w in DATE_NAME.split("|"))]
    texts = string_columns(df) if order_by else []
    sniffed = _sniffed(df, list(dict.fromkeys(temporal + named + texts)), order_by)
    profile = profile.join(F.broadcast(sniffed), "column", "left")
    by_share = not order_by
    profile = profile.withColumn(
        "is_url", F.coalesce(F.col("url_share") >= 0.5 if by_share else F.col("url"), F.lit(False))
    ).withColumn("is_email", F.coalesce(F.col("email_share") >= 0.5 if by_share else F.col("email"), F.lit(False)))
    profile = profile.withColumn("date_format", F.coalesce("date_format", F.lit("unknown")))
    out = _rich(profile) if rules == "rich" else _simple(profile)
    advice = F.create_map(*[F.lit(x) for pair in RECOMMENDATION.items() for x in pair])
    return out.select(
        "column",
        "position",
        "role",
        "subtype",
        "confidence",
        "physical",
        "n_rows",
        "n_distinct",
        "n_singleton",
        "ratio",
        "n_missing",
        "pct_missing",
        "mean",
        "std",
        "min",
        "max",
        "avg_length",
        "max_length",
        "first_value",
        "last_value",
        F.coalesce("has_time", F.lit(False)).alias("has_time"),
        advice[F.col("role")].alias("recommendation"),
    )


def identifiers(roles: DataFrame) -> DataFrame:
    """Identifier columns with their kind, uniqueness and confidence."""
    return roles.where(F.col("role") == "identifier").select("column", "subtype", "n_distinct", "ratio", "confidence")


def foreign_keys(roles: DataFrame) -> DataFrame:
    return roles.where(F.col("role") == "foreign_key").select("column", "n_distinct", "ratio", "confidence")


def numeric_roles(df: DataFrame, roles: DataFrame) -> DataFrame:
    """Numeric columns with their subtype, spread and median."""
    picked = roles.where(F.col("role") == "numeric")
    names = [r["column"] for r in picked.select("column").collect()]
    medians = quantiles(df, names, [0.5])
    table = _rows(df.sparkSession, [(c, medians[c][0]) for c in names], "column string, median double")
    return picked.select(
        "column", "subtype", (F.col("n_distinct") > 20).alias("is_continuous"), "mean", "std", "min", "max"
    ).join(table, "column")


def binary_roles(roles: DataFrame) -> DataFrame:
    """Two-valued columns with their values and the kind of pair they form."""
    return roles.where(F.col("role") == "binary").select(
        "column", "subtype", "first_value", "last_value", binary_subtype("first_value", "last_value").alias("value_kind")
    )


def categorical_roles(df: DataFrame, roles: DataFrame, k: int = 10) -> DataFrame:
    """Categories with cardinality, mode and whether their values suggest an order."""
    picked = roles.where(F.col("role") == "categorical")
    names = [r["column"] for r in picked.select("column").collect()]
    tops = top_values(df, names, k) if names else None
    if tops is None:
        return picked.select("column", "subtype", "n_distinct", F.lit(False).alias("is_ordinal"), F.lit("").alias("mode"))
    flags = tops.groupBy("column").agg(
        F.bool_or(F.lower("value").rlike(ORDINAL_WORDS)).alias("is_ordinal"),
        F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("mode"),
    )
    return picked.select("column", "subtype", "n_distinct").join(flags, "column", "left")


def text_roles(roles: DataFrame) -> DataFrame:
    """Text columns with their kind and lengths."""
    return roles.where(F.col("role") == "string").select("column", "subtype", "avg_length", "max_length")


def date_roles(roles: DataFrame) -> DataFrame:
    return roles.where(F.col("role") == "date").select("column", "subtype", "has_time")


def role_listing(roles: DataFrame, *wanted: str) -> DataFrame:
    """Columns of the given roles."""
    return roles.where(F.col("role").isin(*wanted)).select("column", "role", "subtype", "n_distinct", "ratio")


def role_counts(roles: DataFrame) -> DataFrame:
    """Number of columns per role; roles without columns count zero."""
    every = _rows(roles.sparkSession, [(r,) for r in ROLES], "role string")
    found = roles.groupBy("role").agg(F.count(F.lit(1)).alias("n_columns"))
    return every.join(found, "role", "left").select("role", F.coalesce("n_columns", F.lit(0)).alias("n_columns"))
