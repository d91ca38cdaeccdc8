"""Scalar expressions: null tokens, number parsing, non-finite values, complex cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that mean "missing" once trimmed and lower-cased.
NULL_TOKENS = ("", "nan", "null", "undefined")

# Fixed value: label of a missing class or category.
UNKNOWN = "Unknown"

NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def as_column(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_temporal(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the numeric columns, in schema order."""
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    """Names of the string columns, in schema order."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def select_existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the named columns that exist; fail only when none does."""
    present = [c for c in columns if c in df.columns]
    if not present:
        raise ValueError(f"none of the columns {list(columns)} exists")
    return df.select(*[as_column(c) for c in present])


def select_kind(df: DataFrame, kind: str) -> DataFrame:
    """Keep the ``numeric`` or the ``string`` columns."""
    pick = {"numeric": numeric_columns, "string": string_columns}[kind]
    return df.select(*[as_column(c) for c in pick(df)])


def null_tokens(c: str | Column) -> Column:
    """Null for blank text and for the words that mean missing."""
    c = as_column(c)
    return F.when(~F.lower(F.trim(c)).isin(*NULL_TOKENS), c)


def finite(c: str | Column) -> Column:
    """Null for NaN and for positive or negative infinity, as a double."""
    c = as_column(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def finite_table(df: DataFrame) -> DataFrame:
    """Replace non-finite cells of every float and double column with null."""
    floats = {f.name: f.dataType for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(
        *[
            finite(f.name).cast(f.dataType).alias(f.name) if f.name in floats else as_column(f.name)
            for f in df.schema
        ]
    )


def measure(df: DataFrame, name: str) -> Column:
    """A numeric column as a double whose missing cells are all null."""
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return finite(name)
    return as_column(name).cast("double")


def parse_number(c: str | Column, lenient: bool = False) -> Column:
    """Text to double.

    Strict parsing needs the whole trimmed text to be a number. Lenient parsing
    reads the leading number and ignores what follows it. The pattern guards the
    cast, which would otherwise also accept type suffixes and words such as
    ``Infinity``.
    """
    text = F.trim(as_column(c))
    if lenient:
        text = F.nullif(F.regexp_extract(text, f"^({NUMBER})", 1), F.lit(""))
        return finite(text.try_cast("double"))
    return finite(F.when(text.rlike(f"^{NUMBER}$"), text.try_cast("double")))


#: A JSON array whose first element is a number.
JSON_NUMBER = r"^\[\s*(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)\s*[,\]]"


def scalar_cell(df: DataFrame, name: str) -> Column:
    """Reduce a complex cell to one scalar.

    Numeric arrays give their first element (0.0 if it is not finite). Other
    arrays give their only element, or the whole list as JSON text. Maps and
    structs become JSON text. Text holding a JSON array whose first element is a
    number gives that number as written; any other text, also ``[]``, stays whole.
    """
    c = as_column(name)
    data_type = df.schema[name].dataType
    if isinstance(data_type, T.ArrayType):
        if is_numeric(data_type.elementType):
            first = F.get(c, F.lit(0)).cast("double")
            return F.when(first.isNotNull(), F.coalesce(finite(first), F.lit(0.0)))
        return (
            F.when(F.size(c) == 1, F.get(c, F.lit(0)).cast("string"))
            .when(F.size(c) > 1, F.to_json(c))
        )
    if isinstance(data_type, (T.MapType, T.StructType)):
        return F.to_json(c)
    if isinstance(data_type, T.StringType):
        number = F.regexp_extract(c, JSON_NUMBER, 1)
        return F.when((number != "") & F.from_json(c, "array<string>").isNotNull(), number).otherwise(c)
    return c


def scalar_table(df: DataFrame, texts: bool = False) -> DataFrame:
    """Apply :func:`scalar_cell` to every complex column, with ``texts`` to every text column as well."""
    kinds = (T.ArrayType, T.MapType, T.StructType) + ((T.StringType,) if texts else ())
    return df.select(
        *[
            scalar_cell(df, f.name).alias(f.name) if isinstance(f.dataType, kinds) else as_column(f.name)
            for f in df.schema
        ]
    )


def scalar_sql(name: str, data_type: T.DataType) -> str:
    """:func:`scalar_cell` as SQL text, for transformers that are saved."""
    c = "`" + name.replace("`", "``") + "`"
    if isinstance(data_type, T.ArrayType):
        if is_numeric(data_type.elementType):
            first = f"CAST(get({c}, 0) AS DOUBLE)"
            finite_first = f"IF(isnan({first}) OR abs({first}) = double('Infinity'), 0D, {first})"
            return f"IF({first} IS NULL, NULL, {finite_first})"
        return f"CASE WHEN size({c}) = 1 THEN CAST(get({c}, 0) AS STRING) WHEN size({c}) > 1 THEN to_json({c}) END"
    if isinstance(data_type, (T.MapType, T.StructType)):
        return f"to_json({c})"
    if isinstance(data_type, T.StringType):
        number = f"regexp_extract({c}, r'{JSON_NUMBER}', 1)"
        return f"IF({number} != '' AND from_json({c}, 'array<string>') IS NOT NULL, {number}, {c})"
    return c


def clean_target(df: DataFrame, name: str) -> Column:
    """Class label as text; a missing label is its own class."""
    return F.coalesce(scalar_cell(df, name).cast("string"), F.lit(UNKNOWN))


def in_range(c: str | Column, low: float, high: float) -> Column:
    """Range predicate, both ends included; null is outside."""
    return as_column(c).between(low, high)


def fill_remaining(df: DataFrame) -> DataFrame:
    """Zero for every null left in a numeric column."""
    return df.na.fill(0)


def text_cell(df: DataFrame, name: str) -> Column:
    """One text form per distinct value, so columns of any type can share a shuffle."""
    data_type = df.schema[name].dataType
    c = as_column(name)
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return (finite(name) + F.lit(0.0)).cast("string")
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def row_key(df: DataFrame, columns: Sequence[str] | None = None) -> list[Column]:
    """Grouping columns that identify a row, with long text replaced by a digest.

    Grouping on the digest keeps document-sized cells out of the shuffle. The
    length column stops a digest from ever meeting a short text of the same form.
    """
    keys: list[Column] = []
    for i, name in enumerate(columns or df.columns):
        c = as_column(name)
        if isinstance(df.schema[name].dataType, T.StringType):
            keys.append(F.length(c).alias(f"len_{i}"))
            keys.append(F.when(F.length(c) > 128, F.sha2(c, 256)).otherwise(c).alias(f"key_{i}"))
        elif isinstance(df.schema[name].dataType, (T.MapType, T.VariantType)):
            keys.append(F.to_json(c).alias(f"key_{i}"))
        else:
            keys.append(c.alias(f"key_{i}"))
    return keys
