"""Chart tables."""

from __future__ import annotations

from checks.common import EVENTS_GAPS, NUMERIC, each, events_gaps, query, r, table
from checks.profile_checks import corr_sql, q
from checks.role_checks import rich_sql
from tablewright.operators import charts as V
from tablewright.operators import profile as P
from tablewright.operators import roles as R

CHART_ROWS = ", ".join(f"('{a}', '{b}', [{', '.join(repr(n) for n in needs)}])" for a, b, needs in V.CHARTS)


@query(
    "v1_suitable_charts",
    f"""WITH roles AS (SELECT * FROM {rich_sql('orders')}), facts AS (SELECT count(CASE WHEN role = 'numeric' THEN 1 END) AS n, count(CASE WHEN role = 'categorical' THEN 1 END) AS c, count(CASE WHEN role = 'binary' THEN 1 END) AS b,
    bool_or(regexp_matches("column", 'date|time|year')) AS t, bool_or(regexp_matches("column", 'lat|lng|location|city')) AS g FROM roles),
    charts AS (SELECT * FROM (VALUES {CHART_ROWS}) v(category, chart, needs))
    SELECT category, chart FROM charts, facts WHERE (n > 0 AND list_contains(needs, 'numeric')) OR ((c > 0 OR b > 0) AND list_contains(needs, 'categorical')) OR (t AND list_contains(needs, 'time'))
    OR (g AND list_contains(needs, 'geographic')) OR (c > 1 AND list_contains(needs, 'hierarchical')) OR (n >= 2 AND list_contains(needs, 'relational'))""",
)
def _(spark, folder):
    return V.suitable_charts(R.column_roles(table(spark, folder, "orders")))


@query(
    "v2_xy_series",
    f"SELECT event_id AS key, event_type AS x, {r('coalesce(value, 0)')} AS y FROM (SELECT * FROM {EVENTS_GAPS} ORDER BY event_id LIMIT 50) WHERE event_type IS NOT NULL",
)
def _(spark, folder):
    return V.xy_series(events_gaps(spark, folder), "event_type", "value", "event_id")


def histogram_sql(c, source, extra=""):
    starts = "(lo + i * ((hi - lo) / 10))"
    return f"""WITH s AS (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM {source}),
    bins AS (SELECT i AS bin, {starts} AS a, {starts} + (hi - lo) / 10 AS b, hi FROM s, range(10) t(i))
    SELECT CAST(bin AS BIGINT) AS bin, printf('%.1f-%.1f', a, b) AS label,
    (SELECT count(*) FROM {source} WHERE {c} >= a {extra} AND ({c} < (SELECT min(a) FROM bins n WHERE n.bin = bins.bin + 1) OR bin = 9)) AS count FROM bins"""


@query("v3_histogram", histogram_sql("o_totalprice", "orders"))
def _(spark, folder):
    return V.histogram(table(spark, folder, "orders"), "o_totalprice")


@query("v3_histogram_open", histogram_sql("value", "events", "AND (bin < 9 OR value < b)"))
def _(spark, folder):
    return V.histogram(table(spark, folder, "events"), "value", drop_max=True)


@query("v4_pie", f"SELECT coalesce(event_type, 'null') AS name, count(*) AS value FROM {EVENTS_GAPS} GROUP BY 1")
def _(spark, folder):
    return V.pie(events_gaps(spark, folder), "event_type")


@query(
    "v5_radar",
    "SELECT o_orderkey AS key, "
    + ", ".join(
        f"CAST(floor(({c} - (SELECT min({c}) FROM orders)) / CAST((SELECT max({c}) - min({c}) FROM orders) AS DOUBLE) * 100 + 0.5) AS BIGINT) AS {c}"
        for c in NUMERIC["orders"]
    )
    + " FROM orders ORDER BY o_orderkey LIMIT 10",
)
def _(spark, folder):
    return V.radar(table(spark, folder, "orders"), "o_orderkey")


@query(
    "v6_looks_numeric",
    each(
        ["event_id", "user_id", "event_type", "value"],
        f"""SELECT '{{c}}' AS "column", count({{c}}) > 0 AND count({{c}}) = count(TRY_CAST({{c}} AS DOUBLE)) AS is_numeric FROM (SELECT * FROM {EVENTS_GAPS} ORDER BY event_id LIMIT 10)""",
    ),
)
def _(spark, folder):
    return V.looks_numeric(events_gaps(spark, folder), "event_id")


@query(
    "v8_box_plot",
    each(
        NUMERIC["events"],
        f"""SELECT '{{c}}' AS "column", {r('min({c})')} AS min, {r('any_value(q1)')} AS q1, {r('any_value(m)')} AS median, {r('any_value(q3)')} AS q3, {r('max({c})')} AS max,
        {r('min(CASE WHEN {c} >= q1 - 1.5 * (q3 - q1) THEN {c} END)')} AS whisker_low, {r('max(CASE WHEN {c} <= q3 + 1.5 * (q3 - q1) THEN {c} END)')} AS whisker_high,
        count(CASE WHEN {{c}} < q1 - 1.5 * (q3 - q1) OR {{c}} > q3 + 1.5 * (q3 - q1) THEN 1 END) AS n_outliers
        FROM events, (SELECT {q('{c}', 0.25)} AS q1, {q('{c}', 0.5)} AS m, {q('{c}', 0.75)} AS q3 FROM events)""",
    ),
)
def _(spark, folder):
    return V.box_plot(table(spark, folder, "events"))


HEAT = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "v9_correlation_cells",
    " UNION ALL ".join(corr_sql(a, b, "lineitem") for a in HEAT for b in HEAT if a != b)
    + " UNION ALL "
    + " UNION ALL ".join(f"(SELECT '{c}', '{c}', 1.0)" for c in HEAT),
)
def _(spark, folder):
    return P.correlation_cells(table(spark, folder, "lineitem").select(*HEAT))


@query("v10_stacked_bar", "SELECT l_returnflag AS x, l_linestatus AS stack, count(*) AS count FROM lineitem GROUP BY ALL")
def _(spark, folder):
    return V.stacked_bar(table(spark, folder, "lineitem"), "l_returnflag", "l_linestatus")


@query(
    "v11_word_counts",
    "SELECT word, count(*) AS count FROM (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM conversations) WHERE word <> '' GROUP BY word",
)
def _(spark, folder):
    return V.word_counts(table(spark, folder, "conversations"), "text")
