"""Profile, summaries and quality findings."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from checks.common import (
    DATES,
    EVENTS_COPIES,
    EVENTS_GAPS,
    NUMERIC,
    STRING,
    each,
    events_copies,
    events_gaps,
    query,
    r,
    table,
)
from tablewright.functions.quantiles import order_statistics
from tablewright.operators import profile as P
from tablewright.operators import quality as Q

LINEITEM = NUMERIC["lineitem"]
GAPS_NUMERIC = ["event_id", "user_id", "value"]
GAPS_ALL = ["event_id", "user_id", "event_type", "value"]


def q(c: str, p: float) -> str:
    return f"quantile_cont(CAST({c} AS DOUBLE), {p})"


def mode_sql(c: str, source: str) -> str:
    return (
        f"(SELECT {c} FROM (SELECT {c}, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}) "
        f"ORDER BY n DESC, {c} ASC LIMIT 1)"
    )


@query(
    "d0_column_profile",
    each(
        LINEITEM,
        f"""SELECT '{{c}}' AS "column", 'numeric' AS kind, count(*) AS n_rows, count(*) - count({{c}}) AS n_missing,
        count(DISTINCT {{c}}) AS n_distinct,
        (SELECT count(*) FROM (SELECT {{c}} FROM lineitem GROUP BY {{c}} HAVING count(*) = 1)) AS n_singleton,
        {r('avg({c})')} AS mean, {r('stddev_samp(CAST({c} AS DOUBLE))')} AS std, {r('min({c})')} AS min, {r('max({c})')} AS max,
        {r(mode_sql('{c}', 'lineitem'))} AS mode,
        (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY {{c}})) AS mode_count FROM lineitem""",
    )
    + " UNION ALL "
    + each(
        STRING["lineitem"] + DATES["lineitem"],
        """SELECT '{c}', CASE WHEN '{c}' = 'l_shipdate' THEN 'datetime' ELSE 'string' END, count(*), count(*) - count({c}), count(DISTINCT {c}),
        (SELECT count(*) FROM (SELECT {c} FROM lineitem GROUP BY {c} HAVING count(*) = 1)), NULL, NULL, NULL, NULL, NULL,
        (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY {c})) FROM lineitem""",
    ),
)
def _(spark, folder):
    return P.column_profile(table(spark, folder, "lineitem")).select(
        "column",
        "kind",
        "n_rows",
        "n_missing",
        "n_distinct",
        "n_singleton",
        "mean",
        "std",
        "min",
        "max",
        F.when(F.col("kind") == "numeric", F.col("mode").try_cast("double")).alias("mode"),
        "mode_count",
    )


def summary_sql(c_list, source):
    return each(
        c_list,
        f"""SELECT '{{c}}' AS "column", count({{c}}) AS count, count(*) - count({{c}}) AS nulls, {r('avg({c})')} AS mean,
        {r('stddev_samp(CAST({c} AS DOUBLE))')} AS std, {r('min({c})')} AS min, {r(q('{c}', 0.25))} AS q1, {r(q('{c}', 0.5))} AS median,
        {r(q('{c}', 0.75))} AS q3, {r('max({c})')} AS max, count(DISTINCT {{c}}) AS n_distinct FROM {source}""",
    )


@query("d1_numeric_summary", summary_sql(LINEITEM, "lineitem"))
def _(spark, folder):
    return P.numeric_summary(table(spark, folder, "lineitem"))


@query("d1_numeric_summary_with_gaps", summary_sql(GAPS_NUMERIC, EVENTS_GAPS))
def _(spark, folder):
    return P.numeric_summary(events_gaps(spark, folder))


def top_sql(columns, source, k):
    return each(
        columns,
        f"""SELECT '{{c}}' AS "column", rank, value, count FROM (SELECT {{c}} AS value, count(*) AS count,
        row_number() OVER (ORDER BY count(*) DESC, {{c}}) AS rank FROM {source} WHERE {{c}} IS NOT NULL GROUP BY {{c}}) WHERE rank <= {k}""",
    )


@query(
    "d2_categorical_summary",
    each(
        STRING["part"],
        """SELECT '{c}' AS "column", d.n_distinct, d.n_present, d.n_missing, t.rank, t.value, t.count FROM
        (SELECT count(DISTINCT {c}) AS n_distinct, count({c}) AS n_present, count(*) - count({c}) AS n_missing FROM part) d,
        (SELECT {c} AS value, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank FROM part GROUP BY {c}) t WHERE rank <= 5""",
    ),
)
def _(spark, folder):
    return P.categorical_summary(table(spark, folder, "part"))


def describe_sql(columns, source, digits=4):
    return each(
        columns,
        f"""SELECT '{{c}}' AS "column", count({{c}}) AS count, {r('avg({c})', digits)} AS mean, {r('stddev_samp(CAST({c} AS DOUBLE))', digits)} AS std,
        {r('min({c})', digits)} AS min, {r(q('{c}', 0.25), digits)} AS q25, {r(q('{c}', 0.5), digits)} AS q50, {r(q('{c}', 0.75), digits)} AS q75, {r('max({c})', digits)} AS max FROM {source}""",
    )


@query("d5_describe", describe_sql(LINEITEM, "lineitem"))
def _(spark, folder):
    return P.describe(table(spark, folder, "lineitem"))


@query(
    "d6_missing",
    each(
        GAPS_ALL,
        f"""SELECT '{{c}}' AS "column", count(*) - count({{c}}) AS n_missing, {r('(count(*) - count({c})) * 100.0 / count(*)')} AS pct_missing FROM {EVENTS_GAPS}""",
    ),
)
def _(spark, folder):
    return P.missing_counts(events_gaps(spark, folder))


@query(
    "d7_duplicate_rows",
    f"""SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct_rows, CAST(sum(n - 1) AS BIGINT) AS n_duplicates
    FROM (SELECT count(*) AS n FROM {EVENTS_COPIES} GROUP BY event_id, user_id, event_type, value)""",
)
def _(spark, folder):
    return P.duplicate_rows(events_copies(spark, folder))


@query(
    "d8_distinct",
    each(
        LINEITEM + STRING["lineitem"] + DATES["lineitem"],
        """SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_distinct FROM lineitem""",
    ),
)
def _(spark, folder):
    return P.distinct_counts(table(spark, folder, "lineitem"))


def corr_sql(a, b, source):
    return (
        f"""(SELECT '{a}' AS column1, '{b}' AS column2, CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE {r(f'corr({a}, {b})')} END AS correlation FROM {source})"""
    )


@query("d9_correlation", " UNION ALL ".join(corr_sql(a, b, "lineitem") for a, b in combinations(LINEITEM, 2)))
def _(spark, folder):
    return P.correlation(table(spark, folder, "lineitem"))


@query(
    "d9_correlation_with_gaps_and_constant",
    " UNION ALL ".join(corr_sql(a, b, EVENTS_GAPS) for a, b in combinations(GAPS_NUMERIC, 2))
    + " UNION ALL "
    + " UNION ALL ".join(f"(SELECT '{c}', 'k', NULL)" for c in GAPS_NUMERIC),
)
def _(spark, folder):
    return P.correlation(events_gaps(spark, folder).withColumn("k", F.lit(5.0)))


NET = "(SELECT l_quantity, l_extendedprice, l_discount, l_extendedprice * (1 - l_discount) AS net FROM lineitem)"


@query(
    "d10_high_correlations",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        corr_sql(a, b, NET) for a, b in combinations(["l_quantity", "l_extendedprice", "l_discount", "net"], 2)
    )
    + ") WHERE abs(correlation) > 0.8",
)
def _(spark, folder):
    net = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net")
    return P.high_correlations(
        table(spark, folder, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", net)
    )


def outlier_sql(columns, source, digits=4):
    return each(
        columns,
        f"""SELECT '{{c}}' AS "column", count(CASE WHEN {{c}} < lo OR {{c}} > hi THEN 1 END) AS n_outliers,
        {r('count(CASE WHEN {c} < lo OR {c} > hi THEN 1 END) * 100.0 / count(*)', digits)} AS pct_outliers,
        {r('any_value(lo)', digits)} AS lower_bound, {r('any_value(hi)', digits)} AS upper_bound
        FROM {source}, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT {q('{c}', 0.25)} AS q1, {q('{c}', 0.75)} AS q3 FROM {source}))""",
    )


# fences of prices have five decimals, so four would round on a tie


@query("d11_iqr_outliers", outlier_sql(NUMERIC["events"], "events", 6), digits=6)
def _(spark, folder):
    return P.iqr_outliers(table(spark, folder, "events"))


@query("d11_iqr_outliers_lineitem", outlier_sql(LINEITEM, "lineitem", 6), digits=6)
def _(spark, folder):
    return P.iqr_outliers(table(spark, folder, "lineitem"))


@query("d12_top_values", top_sql(["lang", "source"], "documents", 10))
def _(spark, folder):
    return P.top_values(table(spark, folder, "documents").select("lang", "source"), k=10)


@query(
    "d12_mode",
    each(GAPS_ALL, f"""SELECT '{{c}}' AS "column", CAST({mode_sql('{c}', EVENTS_GAPS)} AS VARCHAR) AS mode""").replace(
        "CAST((SELECT value", "CAST((SELECT CAST(value AS DOUBLE)"
    ),
)
def _(spark, folder):
    df = events_gaps(spark, folder)
    return P.column_profile(df).select("column", "mode")


@query(
    "d13_variance_bands",
    each(
        LINEITEM,
        f"""SELECT '{{c}}' AS "column", {r('var_samp(CAST({c} AS DOUBLE))')} AS variance, CASE WHEN var_samp(CAST({{c}} AS DOUBLE)) < 0.01 THEN 'low' ELSE 'high' END AS band FROM lineitem""",
    ),
)
def _(spark, folder):
    return Q.variance_bands(table(spark, folder, "lineitem"))


@query(
    "d14_table_shape",
    """SELECT 'event_id' AS "column", 'bigint' AS dtype, count(*) AS n_rows, CAST(count(*) * 8 AS BIGINT) AS n_bytes FROM events
    UNION ALL SELECT 'ts', 'timestamp_ntz', count(*), CAST(count(*) * 8 AS BIGINT) FROM events
    UNION ALL SELECT 'user_id', 'bigint', count(*), CAST(count(*) * 8 AS BIGINT) FROM events
    UNION ALL SELECT 'event_type', 'string', count(*), CAST(sum(strlen(event_type)) AS BIGINT) FROM events
    UNION ALL SELECT 'value', 'double', count(*), CAST(count(*) * 8 AS BIGINT) FROM events
    UNION ALL SELECT 'props', 'string', count(*), CAST(sum(strlen(props)) AS BIGINT) FROM events""",
)
def _(spark, folder):
    return Q.table_shape(table(spark, folder, "events"))


@query(
    "d15_normalisation_candidates",
    "SELECT * FROM ("
    + each(
        LINEITEM,
        f"""SELECT '{{c}}' AS "column", {r('max({c}) - min({c})')} AS value_range, {r('stddev_samp(CAST({c} AS DOUBLE))')} AS std FROM lineitem""",
    )
    + ") WHERE value_range > 1000 OR std > 100",
)
def _(spark, folder):
    return Q.normalisation_candidates(table(spark, folder, "lineitem"))


def distinct_where(columns, source, condition):
    return (
        "SELECT \"column\", n_distinct FROM ("
        + each(columns, f"""SELECT '{{c}}' AS "column", count(DISTINCT {{c}}) AS n_distinct, count(*) AS n FROM {source}""")
        + f") WHERE {condition}"
    )


@query("d16_discretisation_candidates", distinct_where(LINEITEM, "lineitem", "n_distinct > 20"))
def _(spark, folder):
    return Q.discretisation_candidates(table(spark, folder, "lineitem"))


@query("d17_hierarchy_candidates", distinct_where(STRING["part"], "part", "n_distinct > 5 AND n_distinct < 50"))
def _(spark, folder):
    return Q.hierarchy_candidates(table(spark, folder, "part"))


@query(
    "d18_aggregation_opportunities",
    "SELECT *, 'doc_id,n_chars' AS measures FROM (" + distinct_where(STRING["documents"], "documents", "n_distinct < 0.3 * n") + ")",
)
def _(spark, folder):
    return Q.aggregation_opportunities(table(spark, folder, "documents"))


@query(
    "d19_sampling_recommendation",
    f"SELECT n_rows, least(5000, n_rows) AS sample_size, {r('least(5000, n_rows) / n_rows')} AS sampling_ratio FROM (SELECT count(*) AS n_rows FROM orders) WHERE n_rows > 10000",
)
def _(spark, folder):
    return Q.sampling_recommendation(table(spark, folder, "orders"))


E_NUM, E_TEXT = NUMERIC["events"], STRING["events"]


@query(
    "d20_quality_findings",
    f"""SELECT "column", finding, {r('measure')} AS measure FROM (
    SELECT "column", 'normalise' AS finding, std AS measure FROM ("""
    + each(E_NUM, """SELECT '{c}' AS "column", max({c}) - min({c}) AS w, stddev_samp(CAST({c} AS DOUBLE)) AS std FROM events""")
    + ") WHERE w > 1000 OR std > 100 UNION ALL SELECT \"column\", 'discretise', n_distinct FROM ("
    + distinct_where(E_NUM, "events", "n_distinct > 20")
    + ") UNION ALL SELECT \"column\", 'build_hierarchy', n_distinct FROM ("
    + distinct_where(E_TEXT, "events", "n_distinct > 5 AND n_distinct < 50")
    + ") UNION ALL SELECT \"column\", 'aggregate_by', n_distinct FROM ("
    + distinct_where(E_TEXT, "events", "n_distinct < 0.3 * n")
    + ") UNION ALL SELECT \"column\", 'match_records', n_distinct FROM ("
    + distinct_where(E_TEXT, "events", "n_distinct > 0.5 * n")
    + ") UNION ALL SELECT \"column\", 'outliers', n_outliers FROM ("
    + outlier_sql(E_NUM, "events")
    + ") WHERE n_outliers > 0)",
)
def _(spark, folder):
    return Q.findings(table(spark, folder, "events"))


@query(
    "d21_simple_report",
    each(
        GAPS_NUMERIC,
        f"""SELECT '{{c}}' AS "column", 'numeric' AS type, count({{c}}) AS count, count(*) - count({{c}}) AS n_missing, count(DISTINCT {{c}}) AS n_distinct,
        {r('avg({c})')} AS mean, {r('stddev_samp(CAST({c} AS DOUBLE))')} AS std, {r('min({c})')} AS min, {r('max({c})')} AS max, NULL AS top, NULL AS freq,
        (SELECT n_outliers FROM ({outlier_sql(['{c}'], EVENTS_GAPS)})) AS n_outliers FROM {EVENTS_GAPS}""",
    )
    + " UNION ALL "
    + each(
        ["event_type"],
        f"""SELECT '{{c}}', 'categorical', count({{c}}), count(*) - count({{c}}), count(DISTINCT {{c}}), NULL, NULL, NULL, NULL, {mode_sql('{c}', EVENTS_GAPS)},
        (SELECT max(n) FROM (SELECT count(*) AS n FROM {EVENTS_GAPS} WHERE {{c}} IS NOT NULL GROUP BY {{c}})), NULL FROM {EVENTS_GAPS}""",
    ),
)
def _(spark, folder):
    return Q.simple_report(events_gaps(spark, folder))


@query(
    "d22_quality_score",
    f"""SELECT n_rows, missing_cells, duplicates, {r('1 - (missing_cells + duplicates) / n_rows')} AS score FROM (
    SELECT (SELECT count(*) FROM {EVENTS_GAPS}) AS n_rows,
    (SELECT CAST(sum((event_type IS NULL)::INT + (value IS NULL)::INT) AS BIGINT) FROM {EVENTS_GAPS}) AS missing_cells, CAST(0 AS BIGINT) AS duplicates)""",
)
def _(spark, folder):
    return Q.quality_score(events_gaps(spark, folder))


@query(
    "d23_complete_rows",
    f"SELECT count(*) AS n_rows, {r('avg(CASE WHEN event_type IS NOT NULL AND value IS NOT NULL THEN 1.0 ELSE 0.0 END)')} AS complete_share FROM {EVENTS_GAPS}",
)
def _(spark, folder):
    return Q.complete_row_share(events_gaps(spark, folder))


def nth(c, p, source):
    return f"(SELECT CAST({c} AS DOUBLE) FROM {source} WHERE {c} IS NOT NULL ORDER BY {c} LIMIT 1 OFFSET (SELECT CAST(floor(count({c}) * {p}) AS BIGINT) FROM {source}))"


@query(
    "d24_rank_outliers",
    each(
        GAPS_NUMERIC,
        f"""SELECT '{{c}}' AS "column", count(CASE WHEN {{c}} < lo OR {{c}} > hi THEN 1 END) AS n_outliers,
        {r('count(CASE WHEN {c} < lo OR {c} > hi THEN 1 END) * 100.0 / count(*)')} AS pct_outliers, {r('any_value(lo)')} AS lower_bound, {r('any_value(hi)')} AS upper_bound
        FROM {EVENTS_GAPS}, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT {nth('{c}', 0.25, EVENTS_GAPS)} AS q1, {nth('{c}', 0.75, EVENTS_GAPS)} AS q3))""",
    ),
)
def _(spark, folder):
    return P.iqr_outliers(events_gaps(spark, folder), by_rank=True)


@query(
    "d25_duplicate_records",
    """SELECT count(CASE WHEN n > 1 THEN 1 END) AS n_groups, CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS n_records
    FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang, source)""",
)
def _(spark, folder):
    return Q.duplicate_records(table(spark, folder, "documents"))


@query(
    "d25_duplicate_texts",
    """SELECT count(CASE WHEN n > 1 THEN 1 END) AS n_groups, CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS n_records
    FROM (SELECT count(*) AS n FROM documents GROUP BY text)""",
)
def _(spark, folder):
    return Q.duplicate_records(table(spark, folder, "documents").select("doc_id", "text"))


@query("d26_fusion_suggestions", distinct_where(STRING["customer"], "customer", "n_distinct > 0.5 * n"))
def _(spark, folder):
    return Q.fusion_suggestions(table(spark, folder, "customer"))


@query(
    "describe_with_quality",
    "SELECT a.*, b.n_missing, b.pct_missing, c.n_outliers, c.pct_outliers, c.lower_bound, c.upper_bound FROM ("
    + describe_sql(LINEITEM, "lineitem", 6)
    + ") a JOIN ("
    + each(LINEITEM, """SELECT '{c}' AS "column", count(*) - count({c}) AS n_missing, CAST(0.0 AS DOUBLE) AS pct_missing FROM lineitem""")
    + ') b USING ("column") JOIN ('
    + outlier_sql(LINEITEM, "lineitem", 6)
    + ') c USING ("column")',
    digits=6,
)
def _(spark, folder):
    return P.describe_with_quality(table(spark, folder, "lineitem"))


@query("d12_dotted_names", "SELECT 'a.b' AS \"column\", event_type AS value, count(*) AS n FROM events GROUP BY event_type")
def _(spark, folder):
    counts = P.value_counts(table(spark, folder, "events").select(F.col("event_type").alias("a.b")))
    return counts.select("column", "value", F.col("count").alias("n"))


@query(
    "d5_quantiles_many_rounds",
    each(
        ["l_quantity", "l_extendedprice", "l_discount"],
        " UNION ALL ".join(f"SELECT '{{c}}' AS \"column\", {p}::DOUBLE AS p, {r(f'quantile_cont({{c}}, {p})')} AS value FROM lineitem" for p in (0.01, 0.25, 0.5, 0.99)),
    ),
)
def _(spark, folder):
    columns, probs = ["l_quantity", "l_extendedprice", "l_discount"], [0.01, 0.25, 0.5, 0.99]
    found = order_statistics(table(spark, folder, "lineitem"), columns, probs, small_bracket=20)
    rows = [(c, p, v) for c in columns for p, v in zip(probs, found[c])]
    return spark.createDataFrame(rows, "column string, p double, value double")
