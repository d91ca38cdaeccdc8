"""Scalar functions, scans and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import EVENTS_GAPS, events_gaps, query, r, table
from tablewright.functions import scalars as S
from tablewright.operators import prepare
from tablewright.session import scratch_path
from tablewright.sources import tables as IO

EVENT_COLUMNS = ["event_id", "user_id", "event_type", "value"]
PLAIN_EVENTS = f"SELECT event_id, user_id, event_type, {r('value')} AS value FROM events"

TOKENS = (
    "(SELECT event_id, CASE WHEN event_id % 5 = 0 THEN ' NaN ' WHEN event_id % 5 = 1 THEN 'null' "
    "WHEN event_id % 5 = 2 THEN '' ELSE event_type END AS token FROM events)"
)


def tokens(spark, folder):
    e = F.col("event_id")
    token = (
        F.when(e % 5 == 0, " NaN ").when(e % 5 == 1, "null").when(e % 5 == 2, "").otherwise(F.col("event_type"))
    )
    return table(spark, folder, "events").select("event_id", token.alias("token"))


@query("s1_csv_scan", PLAIN_EVENTS)
def _(spark, folder):
    path = scratch_path(spark, "events_csv")
    IO.write_csv(table(spark, folder, "events").select(*EVENT_COLUMNS), path)
    return IO.read_csv(spark, path)


@query(
    "s2_tolerant_csv_scan",
    f"SELECT event_id, CASE WHEN event_id % 5 < 3 THEN NULL ELSE event_type END AS token, {r('value')} AS value "
    "FROM events WHERE event_id % 9 <> 0",
)
def _(spark, folder):
    # every ninth line has one field too many
    path = scratch_path(spark, "events_lines")
    e = tokens(spark, folder).join(table(spark, folder, "events").select("event_id", "value"), "event_id")
    line = F.concat_ws(
        ",",
        F.col("event_id").cast("string"),
        F.concat(F.lit('"'), F.col("token"), F.lit('"')),
        F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")),
        F.when(F.col("event_id") % 9 == 0, "extra"),
    )
    # written as whole lines, each file with its header line
    lines = e.select(line.alias("event_id,token,value"))
    lines.write.option("header", True).option("sep", "\u0001").option("quote", "\u0000").csv(path)
    return IO.read_csv_tolerant(spark, path).withColumn("event_id", F.col("event_id").cast("long"))


@query("s3_record_scan", f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE {r('value')} END AS value FROM events")
def _(spark, folder):
    path = scratch_path(spark, "events_json")
    cells = F.struct("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    table(spark, folder, "events").select(F.to_json(cells).alias("line")).write.text(path)
    return IO.read_records(spark, path)


@query("s4_cleaned_sink", f"SELECT event_id, user_id, event_type, {r('value')} AS value FROM {EVENTS_GAPS}")
def _(spark, folder):
    path = IO.write_cleaned(events_gaps(spark, folder), scratch_path(spark, "cleaned"), "events.csv")
    return IO.read_csv(spark, path)


@query("s5_csv_quoting", "SELECT event_id, props || ',\"' || event_type || '\"' AS text FROM events")
def _(spark, folder):
    path = scratch_path(spark, "quoted_csv")
    text = F.concat("props", F.lit(',"'), "event_type", F.lit('"'))
    IO.write_csv(table(spark, folder, "events").select("event_id", text.alias("text")), path)
    return IO.read_csv(spark, path, "event_id long, text string")


@query(
    "s6_catalog",
    """SELECT 'events.csv' AS dataset, CAST(4 AS BIGINT) AS n_columns, 'event_id' AS "column", count(*) AS n_rows, CAST(0 AS BIGINT) AS n_missing FROM events
    UNION ALL SELECT 'events.csv', 4, 'user_id', count(*), 0 FROM events
    UNION ALL SELECT 'events.csv', 4, 'event_type', count(*), count(*) - count(CASE WHEN event_id % 11 = 0 THEN NULL ELSE 1 END) FROM events
    UNION ALL SELECT 'events.csv', 4, 'value', count(*), count(*) - count(CASE WHEN event_id % 7 = 0 THEN NULL ELSE 1 END) FROM events
    UNION ALL SELECT 'orders.csv', 2, 'o_orderkey', count(*), 0 FROM orders
    UNION ALL SELECT 'orders.csv', 2, 'o_totalprice', count(*), 0 FROM orders""",
)
def _(spark, folder):
    root = scratch_path(spark, "datasets")
    IO.write_csv(events_gaps(spark, folder), f"{root}/events.csv")
    IO.write_csv(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), f"{root}/orders.csv")
    return IO.catalog_folder(spark, root).select("dataset", "n_columns", "column", "n_rows", "n_missing")


@query("s7_json_export", f"SELECT event_id, user_id, event_type, {r('value')} AS value FROM {EVENTS_GAPS}")
def _(spark, folder):
    path = scratch_path(spark, "export_json")
    gaps = events_gaps(spark, folder)
    broken = gaps.withColumn("value", F.coalesce("value", F.lit(float("nan"))))
    IO.write_json(broken, path)
    return IO.read_records(spark, path, "event_id long, user_id long, event_type string, value double")


@query(
    "p1_null_tokens",
    f"SELECT event_id, CASE WHEN lower(trim(token)) IN ('', 'nan', 'null', 'undefined') THEN NULL ELSE token END AS token FROM {TOKENS}",
)
def _(spark, folder):
    return tokens(spark, folder).select("event_id", S.null_tokens("token").alias("token"))


NUMBER_TEXT = (
    "(SELECT event_id, CASE WHEN event_id % 4 = 0 THEN user_id || 'abc' WHEN event_id % 4 = 1 THEN ' -' || user_id || '.5 ' "
    "WHEN event_id % 4 = 2 THEN user_id || 'e2' ELSE event_type END AS t FROM events)"
)


def number_text(spark, folder):
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    t = (
        F.when(e % 4 == 0, F.concat(u, F.lit("abc")))
        .when(e % 4 == 1, F.concat(F.lit(" -"), u, F.lit(".5 ")))
        .when(e % 4 == 2, F.concat(u, F.lit("e2")))
        .otherwise(F.col("event_type"))
    )
    return table(spark, folder, "events").select("event_id", t.alias("t"))


@query(
    "p2_strict_number",
    f"SELECT event_id, CASE WHEN event_id % 4 IN (1, 2) THEN {r('TRY_CAST(trim(t) AS DOUBLE)')} END AS number FROM {NUMBER_TEXT}",
)
def _(spark, folder):
    return number_text(spark, folder).select("event_id", S.parse_number("t").alias("number"))


@query(
    "p2_lenient_number",
    f"SELECT event_id, {r('TRY_CAST(CASE WHEN event_id % 4 = 0 THEN replace(t, chr(97) || chr(98) || chr(99), chr(32)) ELSE t END AS DOUBLE)')} AS number FROM {NUMBER_TEXT}",
)
def _(spark, folder):
    return number_text(spark, folder).select("event_id", S.parse_number("t", lenient=True).alias("number"))


@query(
    "p3_array_to_scalar",
    f"SELECT vec_id, {r('embedding[1]', 5)} AS first_value FROM embeddings",
    digits=5,
)
def _(spark, folder):
    df = table(spark, folder, "embeddings")
    return df.select("vec_id", S.scalar_cell(df, "embedding").alias("first_value"))


@query(
    "p3_text_to_scalar",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '[\"' || event_type || '\"]' WHEN event_id % 3 = 1 THEN CAST(event_id AS VARCHAR) "
    "ELSE props END AS cell FROM events",
)
def _(spark, folder):
    e = F.col("event_id")
    listed = (
        F.when(e % 3 == 0, F.to_json(F.array("event_type")))
        .when(e % 3 == 1, F.concat(F.lit("["), e.cast("string"), F.lit(', "x"]')))
        .otherwise(F.col("props"))
    )
    df = table(spark, folder, "events").select("event_id", listed.alias("cell"))
    return df.select("event_id", S.scalar_cell(df, "cell").alias("cell"))


@query(
    "p4_non_finite_to_null",
    f"SELECT event_id, CASE WHEN event_id % 13 = 0 OR event_id % 17 = 0 THEN NULL ELSE {r('value')} END AS value FROM events",
)
def _(spark, folder):
    e = F.col("event_id")
    value = (
        F.when(e % 13 == 0, F.lit(float("nan"))).when(e % 17 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    )
    return S.finite_table(table(spark, folder, "events").select("event_id", value.alias("value")))


@query("p5_select_existing", f"SELECT o_orderkey, {r('o_totalprice')} AS o_totalprice FROM orders")
def _(spark, folder):
    return S.select_existing(table(spark, folder, "orders"), ["o_orderkey", "absent", "o_totalprice"])


@query("p6_select_numeric", f"SELECT o_orderkey, o_custkey, {r('o_totalprice')} AS o_totalprice FROM orders")
def _(spark, folder):
    return S.select_kind(table(spark, folder, "orders"), "numeric")


@query("p6_select_text", "SELECT o_orderstatus, o_orderpriority FROM orders")
def _(spark, folder):
    return S.select_kind(table(spark, folder, "orders"), "string")


VOTED = (
    "(SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS mostly_number, "
    "CASE WHEN event_id % 4 = 0 THEN CAST(user_id AS VARCHAR) ELSE event_type END AS mostly_text FROM events)"
)


@query(
    "p7_numeric_vote",
    f"SELECT event_id, {r('coalesce(TRY_CAST(mostly_number AS DOUBLE), 0.0)')} AS mostly_number, mostly_text FROM {VOTED}",
)
def _(spark, folder):
    quarter, user = F.col("event_id") % 4 == 0, F.col("user_id").cast("string")
    df = table(spark, folder, "events").select(
        "event_id",
        F.when(quarter, F.col("event_type")).otherwise(user).alias("mostly_number"),
        F.when(quarter, user).otherwise(F.col("event_type")).alias("mostly_text"),
    )
    return prepare.coerce_by_vote(df)


@query(
    "p8_label_encode",
    """WITH b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part)),
    t AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part)),
    n AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS code FROM (SELECT DISTINCT p_name FROM part))
    SELECT p_partkey, n.code AS p_name, b.code AS p_brand, t.code AS p_type FROM part JOIN b USING (p_brand) JOIN t USING (p_type) JOIN n USING (p_name)""",
)
def _(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return prepare.label_encode(df)


@query("p8_label_encode_drops_wide", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END::BIGINT AS o_orderstatus FROM orders")
def _(spark, folder):
    df = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", F.concat(F.lit("key"), F.col("o_orderkey").cast("string")).alias("wide")
    )
    return prepare.label_encode(df)


@query(
    "p8_dotted_names",
    """SELECT o_orderkey AS "o.key", CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END::BIGINT AS "o.status",
    CAST(o_orderstatus = 'O' AS BIGINT) AS "s.t_O", CAST(o_orderstatus = 'P' AS BIGINT) AS "s.t_P" FROM orders""",
)
def _(spark, folder):
    status = F.col("o_orderstatus")
    df = table(spark, folder, "orders").select(F.col("o_orderkey").alias("o.key"), status.alias("o.status"), status.alias("s.t"))
    return prepare.label_encode(prepare.one_hot(df, ["s.t"]))


@query("p9_clean_target", f"SELECT event_id, coalesce(event_type, 'Unknown') AS target FROM {EVENTS_GAPS}")
def _(spark, folder):
    df = events_gaps(spark, folder)
    return df.select("event_id", S.clean_target(df, "event_type").alias("target"))


@query(
    "p10_target_round_trip",
    "WITH b AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events)) "
    "SELECT event_id, code, event_type AS decoded FROM events JOIN b USING (event_type)",
)
def _(spark, folder):
    df = table(spark, folder, "events").select("event_id", "event_type")
    indexer, decoder = prepare.target_codec(df, "event_type", "code", "code", "decoded")
    return decoder.transform(indexer.transform(df)).select("event_id", F.col("code").cast("long").alias("code"), "decoded")


@query("p11_fill_remaining", f"SELECT event_id, user_id, event_type, {r('coalesce(value, 0)')} AS value FROM {EVENTS_GAPS}")
def _(spark, folder):
    return S.fill_remaining(events_gaps(spark, folder))


@query(
    "p12_one_hot",
    "SELECT o_orderkey, CAST(o_orderstatus = 'O' AS BIGINT) AS \"o_orderstatus_O\", CAST(o_orderstatus = 'P' AS BIGINT) AS \"o_orderstatus_P\" FROM orders",
)
def _(spark, folder):
    return prepare.one_hot(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])


@query("p13_range_filter", f"SELECT event_id, {r('value')} AS value FROM {EVENTS_GAPS} WHERE value >= 5 AND value <= 20")
def _(spark, folder):
    return events_gaps(spark, folder).where(S.in_range("value", 5, 20)).select("event_id", "value")
