"""Cleaning, transformation and reduction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.common import (
    EVENTS_COPIES,
    EVENTS_GAPS,
    NUMERIC,
    ORDERS_SPIKES,
    each,
    events_copies,
    events_gaps,
    orders_spikes,
    query,
    r,
    table,
)
from checks.profile_checks import mode_sql, q
from tablewright.operators import clean as C
from tablewright.operators import reduce as D
from tablewright.operators import transform as X

GAP_COLUMNS = f"event_id, user_id, event_type, {r('value')} AS value"
EVENT_MODE = mode_sql("event_type", EVENTS_GAPS)


@query("c1_remove_rows", f"SELECT {GAP_COLUMNS} FROM {EVENTS_GAPS} WHERE event_type IS NOT NULL AND value IS NOT NULL")
def _(spark, folder):
    return C.drop_missing(events_gaps(spark, folder))


def filled(value_sql, text_sql):
    return f"SELECT event_id, user_id, coalesce(event_type, {text_sql}) AS event_type, {r(f'coalesce(value, {value_sql})')} AS value FROM {EVENTS_GAPS}"


@query("c2_fill_mean", filled(f"(SELECT avg(value) FROM {EVENTS_GAPS})", EVENT_MODE))
def _(spark, folder):
    return C.fill_mean(events_gaps(spark, folder))


@query(
    "c2_fill_mean_integer",
    f"SELECT event_id, {r('coalesce(u, (SELECT avg(u) FROM (SELECT CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS u FROM events)))')} AS user_id FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS u FROM events)",
)
def _(spark, folder):
    user = F.when(F.col("event_id") % 3 != 0, F.col("user_id"))
    return C.fill_mean(table(spark, folder, "events").select("event_id", user.alias("user_id")))


@query("c3_fill_mode", filled(mode_sql("value", EVENTS_GAPS), EVENT_MODE))
def _(spark, folder):
    return C.fill_mode(events_gaps(spark, folder))


MEDIAN = f"(SELECT {q('value', 0.5)} FROM {EVENTS_GAPS})"


@query("c4_fill_median", f"SELECT event_id, user_id, event_type, {r(f'coalesce(value, {MEDIAN})')} AS value FROM {EVENTS_GAPS}")
def _(spark, folder):
    return C.fill_median(events_gaps(spark, folder))


@query("c5_fill_mode_text", f"SELECT event_id, user_id, coalesce(event_type, {EVENT_MODE}) AS event_type, {r('value')} AS value FROM {EVENTS_GAPS}")
def _(spark, folder):
    return C.fill_mode(events_gaps(spark, folder), ["event_type"])


@query("c6_drop_duplicates", f"SELECT DISTINCT event_id, user_id, event_type, {r('value')} AS value FROM {EVENTS_COPIES}")
def _(spark, folder):
    return C.drop_duplicates(events_copies(spark, folder))


def iqr_chain(columns, source):
    """CTEs that filter one column after another."""
    ctes, previous = [], source
    for i, c in enumerate(columns):
        ctes.append(
            f"s{i} AS (SELECT t.* FROM {previous} t, (SELECT {q(c, 0.25)} AS q1, {q(c, 0.75)} AS q3 FROM {previous}) b "
            f"WHERE {c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1))"
        )
        previous = f"s{i}"
    return "WITH " + ", ".join(ctes), previous


SPIKE_COLUMNS = f"o_orderkey, o_custkey, {r('o_totalprice')} AS o_totalprice, o_orderstatus, o_orderpriority"
_ctes, _last = iqr_chain(NUMERIC["orders"], ORDERS_SPIKES)


@query("c7_remove_outliers", f"{_ctes} SELECT {SPIKE_COLUMNS} FROM {_last}")
def _(spark, folder):
    return C.remove_outliers(orders_spikes(spark, folder))


_gap_ctes, _gap_last = iqr_chain(NUMERIC["events"], EVENTS_GAPS)


@query("c7_remove_outliers_with_gaps", f"{_gap_ctes} SELECT {GAP_COLUMNS} FROM {_gap_last}")
def _(spark, folder):
    return C.remove_outliers(events_gaps(spark, folder))


def fences(columns, source):
    return ", ".join(
        f"{q(c, 0.25)} - 1.5 * ({q(c, 0.75)} - {q(c, 0.25)}) AS lo_{c}, {q(c, 0.75)} + 1.5 * ({q(c, 0.75)} - {q(c, 0.25)}) AS hi_{c}"
        for c in columns
    )


@query(
    "c7_remove_outliers_together",
    f"SELECT {SPIKE_COLUMNS} FROM {ORDERS_SPIKES}, (SELECT {fences(NUMERIC['orders'], ORDERS_SPIKES)} FROM {ORDERS_SPIKES}) WHERE "
    + " AND ".join(f"{c} BETWEEN lo_{c} AND hi_{c}" for c in NUMERIC["orders"]),
)
def _(spark, folder):
    return C.remove_outliers(orders_spikes(spark, folder), simultaneous=True)


@query("c8_keep", f"SELECT {GAP_COLUMNS} FROM {EVENTS_GAPS}")
def _(spark, folder):
    from tablewright.plans.cleaning import CleanOptions, clean

    return clean(events_gaps(spark, folder), CleanOptions(missing="keep", duplicates="keep", outliers="keep"))


DIRTY = (
    "(SELECT event_id, user_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type, "
    f"CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM {EVENTS_COPIES})"
)


def dirty(spark, folder):
    return events_copies(spark, folder).select(
        "event_id",
        "user_id",
        F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
    )


_clean_ctes, _clean_last = iqr_chain(NUMERIC["events"], "unique_rows")
CLEANED = f"""WITH full_rows AS (SELECT event_id, user_id, coalesce(event_type, {mode_sql('event_type', DIRTY)}) AS event_type,
    coalesce(value, (SELECT avg(value) FROM {DIRTY})) AS value FROM {DIRTY}),
    unique_rows AS (SELECT DISTINCT * FROM full_rows), {_clean_ctes[5:]}"""


@query("c9_clean_table", f"{CLEANED} SELECT {GAP_COLUMNS} FROM {_clean_last}")
def _(spark, folder):
    from tablewright.plans.cleaning import CleanOptions, clean

    return clean(dirty(spark, folder), CleanOptions(outliers="remove"))


@query(
    "c9_clean_report",
    f"""{CLEANED} SELECT stage, n_rows, missing_cells, duplicates FROM (
    SELECT 'before' AS stage, (SELECT count(*) FROM {DIRTY}) AS n_rows,
    (SELECT CAST(sum((event_type IS NULL)::INT + (value IS NULL)::INT) AS BIGINT) FROM {DIRTY}) AS missing_cells,
    (SELECT count(*) FROM {DIRTY}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {DIRTY})) AS duplicates
    UNION ALL SELECT 'after', (SELECT count(*) FROM {_clean_last}), CAST(0 AS BIGINT), CAST(0 AS BIGINT))""",
)
def _(spark, folder):
    from tablewright.plans.cleaning import CleanOptions, clean, compare

    before = dirty(spark, folder)
    return compare(before, clean(before, CleanOptions(outliers="remove"))).select(
        "stage", "n_rows", "missing_cells", "duplicates"
    )


@query(
    "c9_clean_quality_reports",
    f"""{CLEANED} SELECT 'before' AS stage, 'n_missing' AS finding, CAST(sum((event_type IS NULL)::INT + (value IS NULL)::INT) AS BIGINT) AS total FROM {DIRTY}
    UNION ALL SELECT 'after', 'n_missing', CAST(0 AS BIGINT)
    UNION ALL SELECT 'before', 'n_rows', count(*) FROM {DIRTY} UNION ALL SELECT 'after', 'n_rows', count(*) FROM {_clean_last}
    UNION ALL SELECT 'after', 'n_distinct_values', CAST(count(DISTINCT event_type) AS BIGINT) FROM {_clean_last}""",
)
def _(spark, folder):
    from tablewright.plans.cleaning import CleanOptions, clean_with_reports

    run = clean_with_reports(dirty(spark, folder), CleanOptions(outliers="remove"))

    def totals(stage: str, report, finding: str, measure):
        return report.agg(measure.cast("long").alias("total")).select(F.lit(stage).alias("stage"), F.lit(finding).alias("finding"), "total")

    parts = []
    for stage, found in (("before", run.before), ("after", run.after)):
        parts.append(totals(stage, found["missing"], "n_missing", F.sum("n_missing")))
        parts.append(totals(stage, found["roles"], "n_rows", F.max("n_rows")))
    parts.append(totals("after", run.after["roles"].where("column = 'event_type'"), "n_distinct_values", F.max("n_distinct")))
    return reduce(DataFrame.unionByName, parts)


@query("c10_fill_zero", filled("0", "'Unknown'"))
def _(spark, folder):
    return C.fill_zero(events_gaps(spark, folder))


@query(
    "c11_cap",
    f"""SELECT o_orderkey, {r('least(greatest(o_totalprice, lo), hi)')} AS o_totalprice FROM {ORDERS_SPIKES},
    (SELECT {q('o_totalprice', 0.05)} AS lo, {q('o_totalprice', 0.95)} AS hi FROM {ORDERS_SPIKES})""",
)
def _(spark, folder):
    return C.cap_outliers(orders_spikes(spark, folder), ["o_totalprice"]).select("o_orderkey", "o_totalprice")


@query(
    "c12_median_strategy",
    f"SELECT event_id, user_id, coalesce(event_type, {EVENT_MODE}) AS event_type, {r(f'coalesce(value, {MEDIAN})')} AS value FROM {EVENTS_GAPS}",
)
def _(spark, folder):
    from tablewright.plans.cleaning import CleanOptions, clean

    return clean(events_gaps(spark, folder), CleanOptions(missing="fill_median", duplicates="keep"))


@query(
    "c13_forward_fill",
    f"""SELECT event_id, user_id, last_value(event_type IGNORE NULLS) OVER w AS event_type, {r('last_value(value IGNORE NULLS) OVER w')} AS value
    FROM {EVENTS_GAPS} WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def _(spark, folder):
    return C.forward_fill(events_gaps(spark, folder), "user_id", "event_id", ["event_type", "value"])


for _keep, _dir in (("first", "ASC"), ("last", "DESC")):

    @query(
        f"c14_keep_{_keep}",
        f"SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id {_dir}) AS rn FROM events) WHERE rn = 1",
    )
    def _(spark, folder, _keep=_keep):
        df = table(spark, folder, "events").select("event_id", "user_id", "event_type")
        return C.keep_one(df, ["user_id", "event_type"], "event_id", _keep)


@query(
    "c15_z_outliers",
    f"SELECT {SPIKE_COLUMNS} FROM {ORDERS_SPIKES}, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM {ORDERS_SPIKES}) WHERE abs(o_totalprice - m) <= 3 * s",
)
def _(spark, folder):
    return C.remove_z_outliers(orders_spikes(spark, folder), ["o_totalprice"])


@query(
    "c16_preview",
    f"""{CLEANED} SELECT n0 AS rows_before, n1 AS rows_after, m0 AS missing_before, CAST(0 AS BIGINT) AS missing_after, n0 - d0 AS duplicates_before, CAST(0 AS BIGINT) AS duplicates_after, n0 - n1 AS rows_removed
    FROM (SELECT (SELECT count(*) FROM {DIRTY}) AS n0, (SELECT count(*) FROM {_clean_last}) AS n1,
    (SELECT CAST(sum((event_type IS NULL)::INT + (value IS NULL)::INT) AS BIGINT) FROM {DIRTY}) AS m0, (SELECT count(*) FROM (SELECT DISTINCT * FROM {DIRTY})) AS d0)""",
)
def _(spark, folder):
    from tablewright.plans.cleaning import CleanOptions, preview

    return preview(dirty(spark, folder), CleanOptions(outliers="remove"))


# transformation

PART_Z = ["p_partkey", "p_size", "p_retailprice"]


@query(
    "x1_zscore",
    "SELECT p_name, "
    + ", ".join(r(f"({c} - (SELECT avg({c}) FROM part)) / (SELECT stddev_pop({c}) FROM part)") + f" AS {c}" for c in PART_Z)
    + f", {r('5.0')} AS k FROM part",
)
def _(spark, folder):
    df = table(spark, folder, "part").select("p_name", *PART_Z).withColumn("k", F.lit(5.0))
    return X.zscore(df)


@query(
    "x1_zscore_report",
    each(
        NUMERIC["lineitem"],
        f"""SELECT '{{c}}' AS "column", {r('avg({c})')} AS mean, {r('stddev_samp(CAST({c} AS DOUBLE))')} AS std, {r('min({c})')} AS min, {r('max({c})')} AS max FROM lineitem""",
    ),
)
def _(spark, folder):
    return X.zscore_report(table(spark, folder, "lineitem"))


def bin_sql(c, source):
    edge = f"(lo + {{k}} * ((hi - lo) / 5))"
    whens = " ".join(
        f"WHEN {c} <= {edge.replace('{k}', str(k))} THEN '{label}'" for k, label in zip(range(1, 5), X.BIN_LABELS)
    )
    return f"CASE {whens} WHEN {c} <= hi THEN 'Very High' END"


def span(c, source):
    return f"(SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM {source})"


@query(
    "x2_equal_width_bins",
    f"SELECT l_orderkey, {r('l_extendedprice')} AS l_extendedprice, {bin_sql('l_extendedprice', 'lineitem')} AS l_extendedprice_discrete, l_linenumber::BIGINT AS l_linenumber FROM lineitem, {span('l_extendedprice', 'lineitem')}",
)
def _(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_extendedprice", "l_linenumber")
    return X.bin_equal_width(df, ["l_extendedprice", "l_linenumber"])


@query(
    "x2_equal_width_bins_with_gaps",
    f"SELECT event_id, {r('value')} AS value, {bin_sql('value', EVENTS_GAPS)} AS value_discrete FROM {EVENTS_GAPS}, {span('value', EVENTS_GAPS)}",
)
def _(spark, folder):
    return X.bin_equal_width(events_gaps(spark, folder).select("event_id", "value"), ["value"])


@query(
    "x3_transform",
    f"""WITH z AS (SELECT event_type, (value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events) AS value FROM events)
    SELECT event_type, {r('value')} AS value, count(*) AS n FROM (SELECT * FROM z) GROUP BY event_type, {r('value')}""",
)
def _(spark, folder):
    df = table(spark, folder, "events").select("event_type", "value")
    out, _summary = X.transform(df)
    return out.withColumn("value", F.round("value", 4) + F.lit(0.0)).groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "x3_transform_summary",
    f"""WITH z AS (SELECT event_type, (value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events) AS value FROM events)
    SELECT event_type, {r('avg(value)')} AS value_mean, {r('sum(value)', 4)} AS value_sum, count(value) AS value_count FROM z GROUP BY event_type""",
)
def _(spark, folder):
    df = table(spark, folder, "events").select("event_type", "value")
    return X.transform(df, X.TransformOptions(discretise=False, aggregate=True))[1]


@query(
    "x4_aggregate_by_first_text",
    "SELECT l_returnflag, "
    + ", ".join(
        f"{r(f'avg({c})')} AS {c}_mean, {r(f'sum({c})', 2)} AS {c}_sum, count({c}) AS {c}_count" for c in ["l_quantity", "l_extendedprice"]
    )
    + " FROM lineitem GROUP BY l_returnflag",
)
def _(spark, folder):
    df = table(spark, folder, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    out = X.aggregate_by_first_text(df)
    return out.withColumns({c: F.round(c, 2) for c in out.columns if c.endswith("_sum")})


def hierarchy_sql(c, source):
    counts = f"(SELECT {c} AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c})"
    level = (
        f"CASE WHEN n >= (SELECT quantile_cont(CAST(n AS DOUBLE), 0.67) FROM {counts}) THEN 'High_Frequency' "
        f"WHEN n >= (SELECT quantile_cont(CAST(n AS DOUBLE), 0.33) FROM {counts}) THEN 'Medium_Frequency' ELSE 'Low_Frequency' END"
    )
    return f"(SELECT v, {level} AS level FROM {counts})"


@query(
    "x5_frequency_hierarchy",
    f"SELECT p_partkey, p_brand, p_type, b.level AS p_brand_hierarchy, t.level AS p_type_hierarchy FROM part JOIN {hierarchy_sql('p_brand', 'part')} b ON b.v = p_brand JOIN {hierarchy_sql('p_type', 'part')} t ON t.v = p_type",
)
def _(spark, folder):
    return X.frequency_hierarchy(table(spark, folder, "part").select("p_partkey", "p_brand", "p_type"))


GAP_BRAND = "(SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS p_brand FROM part)"


@query(
    "x5_frequency_hierarchy_with_gaps",
    f"SELECT p_partkey, p_brand, coalesce(level, 'Low_Frequency') AS p_brand_hierarchy FROM {GAP_BRAND} LEFT JOIN {hierarchy_sql('p_brand', GAP_BRAND)} ON v = p_brand",
)
def _(spark, folder):
    brand = F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand"))
    return X.frequency_hierarchy(table(spark, folder, "part").select("p_partkey", brand.alias("p_brand")))


@query(
    "x6_scale_to_hundred",
    f"SELECT event_id, {r('(coalesce(value, 0) - lo) / (hi - lo) * 100')} AS value, {r('50.0')} AS k FROM {EVENTS_GAPS}, {span('value', EVENTS_GAPS)}",
)
def _(spark, folder):
    df = events_gaps(spark, folder).select("event_id", "value").withColumn("k", F.lit(5.0))
    return X.scale_to_hundred(df, ["value", "k"])


@query(
    "x7_robust_scale",
    f"SELECT event_id, {r('(value - m) / (q3 - q1)')} AS value FROM events, (SELECT {q('value', 0.25)} AS q1, {q('value', 0.5)} AS m, {q('value', 0.75)} AS q3 FROM events)",
)
def _(spark, folder):
    return X.robust_scale(table(spark, folder, "events").select("event_id", "value"), ["value"])


@query(
    "x8_equal_frequency_bins",
    f"SELECT event_id, {r('value')} AS value, CAST(1 + (value > a)::INT + (value > b)::INT + (value > c)::INT + (value > d)::INT AS BIGINT) AS value_bin FROM events, (SELECT {q('value', 0.2)} AS a, {q('value', 0.4)} AS b, {q('value', 0.6)} AS c, {q('value', 0.8)} AS d FROM events)",
)
def _(spark, folder):
    return X.bin_equal_frequency(table(spark, folder, "events").select("event_id", "value"), "value")


@query(
    "x9_threshold_bins",
    f"SELECT event_id, {r('value')} AS value, CASE WHEN value <= 5 THEN 'low' WHEN value <= 20 THEN 'middle' WHEN value IS NOT NULL THEN 'high' END AS value_band FROM {EVENTS_GAPS}",
)
def _(spark, folder):
    df = events_gaps(spark, folder).select("event_id", "value")
    return X.bin_thresholds(df, "value", [5, 20], ["low", "middle", "high"])


@query(
    "x10_chosen_aggregates",
    f"""SELECT l_returnflag, l_linestatus, {r('sum(l_quantity)')} AS l_quantity_sum, {r('avg(l_quantity)')} AS l_quantity_mean, count(l_quantity) AS l_quantity_count,
    {r('min(l_quantity)')} AS l_quantity_min, {r('max(l_quantity)')} AS l_quantity_max, {r('stddev_samp(l_quantity)')} AS l_quantity_std FROM lineitem GROUP BY ALL""",
)
def _(spark, folder):
    return X.aggregate_by(
        table(spark, folder, "lineitem"),
        ["l_returnflag", "l_linestatus"],
        ["l_quantity"],
        ["sum", "mean", "count", "min", "max", "std"],
    )


# reduction


@query("r1_variance_threshold", f"SELECT l_orderkey, l_returnflag, {r('l_extendedprice')} AS l_extendedprice FROM lineitem")
def _(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    return D.variance_threshold(df)


@query("r2_pca")
def _(spark, folder):
    return D.pca(table(spark, folder, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"))


# two uncorrelated-to-the-axes measures have a closed form
@query(
    "r2_pca_shares",
    f"""WITH m AS (SELECT var_samp(a) AS va, var_samp(b) AS vb, var_samp(c) AS vc, covar_samp(a, b) AS ab FROM
    (SELECT p_size::DOUBLE AS a, 2.0 * p_size + (p_partkey % 7) AS b, 0.0 AS c FROM part)),
    e AS (SELECT (va + vb + sqrt((va - vb) * (va - vb) + 4 * ab * ab)) / 2 AS l1, va + vb AS total FROM m)
    SELECT CAST(1 AS BIGINT) AS component, {r('l1 / total')} AS explained, {r('l1 / total')} AS cumulative FROM e""",
)
def _(spark, folder):
    df = table(spark, folder, "part").select(
        F.col("p_size").cast("double").alias("a"),
        (F.col("p_size") * 2.0 + F.col("p_partkey") % 7).alias("b"),
        F.lit(0.0).alias("c"),
    )
    return D.pca_report(df)


@query(
    "r3_stratified_sample_sizes",
    "SELECT event_type, CAST(least(n, greatest(1, floor(1000 * n / total))) AS BIGINT) AS n FROM (SELECT event_type, count(*) AS n, (SELECT count(*) FROM events) AS total FROM events GROUP BY event_type)",
)
def _(spark, folder):
    sample = D.stratified_sample(table(spark, folder, "events"), "event_type", ["event_id"])
    return sample.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "r3_stratified_sample_with_gaps",
    # a table of up to a thousand rows is left as it is
    f"SELECT event_type, CASE WHEN total <= 1000 THEN n ELSE CAST(least(n, greatest(1, floor(1000 * n / total))) AS BIGINT) END AS n, true AS all_from_table FROM (SELECT event_type, count(*) AS n, (SELECT count(*) FROM events) AS total FROM {EVENTS_GAPS} GROUP BY event_type) WHERE event_type IS NOT NULL OR total <= 1000",
)
def _(spark, folder):
    df = events_gaps(spark, folder)
    sample = D.stratified_sample(df, "event_type", ["event_id"])
    # every sampled row is a row of the table
    seen = sample.join(df.select("event_id", F.lit(True).alias("known")), "event_id", "left")
    return seen.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce("known", F.lit(False))).alias("all_from_table")
    )


@query("r4_uniform_sample", "SELECT CAST(least(1000, count(*)) AS BIGINT) AS n, CAST(least(1000, count(*)) AS BIGINT) AS n_distinct FROM events")
def _(spark, folder):
    sample = D.uniform_sample(table(spark, folder, "events"), ["event_id"])
    return sample.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_distinct"))


@query("r4_uniform_sample_rows")
def _(spark, folder):
    return D.uniform_sample(table(spark, folder, "events").select("event_id", "event_type", "value"), ["event_id"])


def encoded(c, source):
    return f"(SELECT {c} AS v, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM {source} GROUP BY {c})"


@query(
    "r5_dictionary_encode",
    f"SELECT event_id, event_type, props, a.code AS event_type_encoded, b.code AS props_encoded FROM events JOIN {encoded('event_type', 'events')} a ON a.v = event_type JOIN {encoded('props', 'events')} b ON b.v = props",
)
def _(spark, folder):
    return D.dictionary_encode(table(spark, folder, "events").select("event_id", "event_type", "props"), "event_id")


@query("r5_dictionary", f"SELECT v AS value, code FROM {encoded('event_type', EVENTS_GAPS)}")
def _(spark, folder):
    return D.first_seen(events_gaps(spark, folder), "event_type", "event_id")


@query(
    "r6_reduction_summary",
    f"SELECT n AS rows_before, CAST(4 AS BIGINT) AS columns_before, n AS rows_after, CAST(2 AS BIGINT) AS columns_after, {r('50.0')} AS pct_reduction FROM (SELECT count(*) AS n FROM lineitem)",
)
def _(spark, folder):
    df = table(spark, folder, "lineitem").select("l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    return D.reduction_summary(df, D.variance_threshold(df))


@query(
    "r7_reduce_sizes",
    "SELECT event_type, CAST(greatest(1, floor(1000 * n / total)) AS BIGINT) AS n FROM (SELECT event_type, count(*) AS n, (SELECT count(*) FROM events) AS total FROM events GROUP BY event_type)",
)
def _(spark, folder):
    out = D.reduce_table(
        table(spark, folder, "events"), "event_id", D.ReduceOptions(pca=False, sampling=True, compress=True)
    )
    return out.groupBy("event_type").agg(F.count("event_type_encoded").alias("n"))


@query("r8_row_cap", "SELECT CAST(least(10000, count(*)) AS BIGINT) AS capped, count(*) AS uncapped FROM orders")
def _(spark, folder):
    orders = table(spark, folder, "orders")
    capped = D.limit_rows(orders, ["o_orderkey"], 10_000).agg(F.count(F.lit(1)).alias("capped"))
    # one row on each side
    return capped.crossJoin(D.limit_rows(orders, ["o_orderkey"]).agg(F.count(F.lit(1)).alias("uncapped")))
