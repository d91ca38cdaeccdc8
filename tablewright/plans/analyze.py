"""Analysis of a whole table: roles, statistics that fit each role, correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.quantiles import quantiles
from tablewright.functions.scalars import numeric_columns
from tablewright.operators import profile as P
from tablewright.operators import roles as R


def analyze(df: DataFrame, rules: str = "rich", exact: bool = True) -> dict[str, DataFrame]:
    """Statistics per column, top values, correlation of the measures, and role counts.

    A column is described as an identifier first, then as binary, numeric and
    categorical; identifiers and binaries get counts only.
    """
    roles = R.column_roles(df, rules, exact=exact)
    # a row per column: small, and read several times below
    found = [row.asDict() for row in roles.collect()]
    roles = df.sparkSession.createDataFrame([tuple(f[c] for c in roles.columns) for f in found], roles.schema)
    numbers = set(numeric_columns(df))
    measured = [f["column"] for f in found if f["column"] in numbers and f["role"] not in ("identifier", "binary")]
    cuts = quantiles(df, measured, [0.25, 0.5, 0.75], exact) if measured else {}
    quartiles = P._rows(
        df.sparkSession, [(c, *cuts[c]) for c in measured], "column string, q1 double, median double, q3 double"
    )
    plain = F.col("role").isin("identifier", "binary")
    columns = roles.join(quartiles, "column", "left").withColumns(
        {c: F.when(~plain, F.col(c)) for c in ("mean", "std", "min", "max")}
    )
    texts = [f["column"] for f in found if f["role"] == "categorical"]
    return {
        "columns": columns,
        "top_values": P.top_values(df, texts, k=5) if texts else P._rows(df.sparkSession, [], "column string, rank int, value string, count long"),
        "correlation": P.correlation(df, measured),
        "role_counts": R.role_counts(roles),
    }
