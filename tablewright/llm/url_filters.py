"""URL filters: captures judged by the list entries that were in force when they were fetched.

Dated list entries (added, removed, added again) become validity intervals. Each capture is looked up by the few keys
its URL can match: its host, the domains above it and the prefixes of its path. An as-of join on key and time finds the
entries in force at the fetch time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.common import table

#: Kinds of pattern by rising strength: of several matches the most specific one is named.
KINDS = ("domain", "host", "prefix")


def _ticks(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.col(name).cast("long")


def _parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case without user, port and final dots, and the path without query and fragment."""
    bare = F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://|^//", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(bare, "^([^/?#]*)", 1), "^.*@|\\.*(:[0-9]*)?$", ""))
    return host, F.regexp_extract(bare, "^[^/?#]*([^?#]*)", 1)


def url_keys(url: Column, depth: int) -> Column:
    """All keys that a list pattern may have to match ``url``; ``depth``: path segments of the deepest pattern."""
    host, path = _parts(url)
    labels = F.split(host, "\\.")
    n = F.size(labels)
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.concat(F.lit("domain "), F.array_join(F.slice(labels, i, n), ".")),
    )
    keys = [domains, F.array(F.concat(F.lit("host "), host))]
    if depth:
        steps = F.filter(F.split(path, "/"), lambda s: s != "")
        prefixes = F.transform(
            F.sequence(F.lit(1), F.least(F.size(steps), F.lit(depth))),
            lambda i: F.concat(F.lit("prefix "), host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")),
        )
        keys.append(F.when(F.size(steps) > 0, prefixes).otherwise(F.array().cast("array<string>")))
    return F.when(host != "", F.array_distinct(F.concat(*keys))).otherwise(F.array().cast("array<string>"))


def _pattern_key(kind: Column, pattern: Column) -> Column:
    host, path = _parts(pattern)
    steps = F.array_join(F.filter(F.split(path, "/"), lambda s: s != ""), "/")
    return F.when(kind == "prefix", F.concat(F.lit("prefix "), host, F.lit("/"), steps)).otherwise(F.concat(kind, F.lit(" "), host))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Entries ``(list_name, kind, pattern, action, at)`` as intervals ``(list_name, key, starts, ends)``, end exclusive.

    ``action`` is ``add`` or ``remove``. An open interval has a null end. Entries of one pattern at the same instant
    count once, and an addition wins over a removal. Entries with a null field or another action are ignored.
    """
    dated = (
        entries.select(
            "list_name",
            _pattern_key(F.lower("kind"), F.col("pattern")).alias("key"),
            (F.lower("action") == "add").alias("adds"),
            _ticks(entries, "at").alias("starts"),
        )
        .where(F.lower("kind").isin(*KINDS) & F.lower("action").isin("add", "remove"))
        .dropna()
        .groupBy("list_name", "key", "starts")
        .agg(F.max("adds").alias("adds"))
    )
    by_key = Window.partitionBy("list_name", "key").orderBy("starts")
    return dated.withColumn("ends", F.lead("starts").over(by_key)).where("adds").drop("adds")


def judge_captures(captures: DataFrame, entries: DataFrame, url: str = "url", fetched_at: str = "fetched_at", period: int = 30 * 86_400, salts: int = 4) -> DataFrame:
    """Every capture with the verdict of the lists at its fetch time.

    Adds ``blocked`` (boolean), ``n_matches`` (long: lists and patterns in force that match), and of the most specific
    match, ties to the smallest list name, ``match_key``, ``match_list`` and ``match_since`` (in ticks of the fetch
    time: its own unit, microseconds for timestamps). Columns of the captures with one of these names are replaced.
    A capture with a null URL or fetch time has ``blocked`` null and no match; a URL without host matches nothing.
    Repeated captures are all kept. ``period`` (ticks) and ``salts`` only spread the join: intervals are listed under
    each period they touch, so a key with a third of all captures is met by many tasks.
    """
    spans = validity_intervals(entries)
    seen = captures.select(F.col(f"`{url}`").alias("url"), _ticks(captures, fetched_at).alias("t")).dropna().distinct()
    bounds = seen.agg(F.min("t"), F.max("t")).first()
    depth = spans.agg(F.max(F.when(F.col("key").startswith("prefix "), F.size(F.split("key", "/")) - 1))).first()[0] or 0
    own = [c for c in captures.columns if c not in ("blocked", "n_matches", "match_key", "match_list", "match_since")]
    if bounds[0] is None:
        bounds = (0, 0)
    first, last = bounds[0] // period, bounds[1] // period
    listed = (
        spans.where((F.col("starts") <= bounds[1]) & (F.coalesce("ends", F.lit(bounds[1] + 1)) > bounds[0]))
        .withColumn(
            "span",
            F.explode(
                F.sequence(
                    F.greatest(F.floor(F.col("starts") / period), F.lit(first)),
                    F.least(F.floor(F.coalesce(F.col("ends") - 1, F.lit(bounds[1])) / period), F.lit(last)),
                )
            ),
        )
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    wanted = seen.select(
        "url",
        "t",
        F.floor(F.col("t") / period).alias("span"),
        F.pmod(F.xxhash64("url", "t"), F.lit(salts)).cast("int").alias("salt"),
        F.explode(url_keys(F.col("url"), depth)).alias("key"),
    )
    met = wanted.join(listed, ["key", "span", "salt"]).where("starts <= t AND (ends IS NULL OR t < ends)")
    strength = F.when(F.col("key").startswith("prefix "), 2).when(F.col("key").startswith("host "), 1).otherwise(0)
    order = F.struct((-strength).alias("s"), (-F.length("key")).alias("l"), "list_name", "key", "starts")
    verdicts = met.groupBy("url", "t").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("best"))
    # the capture travels as one struct, so no column of its meets another's name
    judged = captures.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("capture"), F.col(f"`{url}`").alias("url"), _ticks(captures, fetched_at).alias("t"))
    judged = judged.join(verdicts, ["url", "t"], "left")
    known = F.col("url").isNotNull() & F.col("t").isNotNull()
    return judged.select(
        *[F.col("capture").getField(c).alias(c) for c in own],
        F.when(known, F.col("n").isNotNull()).alias("blocked"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_matches"),
        F.col("best.key").alias("match_key"),
        F.col("best.list_name").alias("match_list"),
        F.col("best.starts").alias("match_since"),
    )


#: Rules by which the query derives fetch times and dated lists from the pages themselves, so that both grow with them.
DAY = 86_400
START = 1_704_067_200


def page_captures(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", (F.lit(START) + F.pmod(F.col("page_id") * 7919 * 61, F.lit(365 * DAY))).cast("long").alias("fetched_at"))


def page_lists(pages: DataFrame) -> DataFrame:
    """A list of hosts with additions, removals and second additions; one of domains; one of path prefixes."""
    hosts = pages.select(_parts(F.col("url"))[0].alias("host")).where("host != ''").distinct()

    def digit(i: int, column: str) -> Column:
        return F.expr(f"locate(substring(md5({column}), {i}, 1), '0123456789abcdef') - 1").cast("long")

    def dated(df: DataFrame, name: str, kind: str, pattern: Column, action: str, at: Column) -> DataFrame:
        return df.select(F.lit(name).alias("list_name"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), at.cast("long").alias("at"))

    begins = START + digit(2, "host") * 20 * DAY
    ends = begins + (digit(3, "host") + 1) * 8 * DAY
    bad = hosts.where(digit(1, "host") < 8)
    domains = hosts.select(F.expr("substring_index(host, '.', -2)").alias("host")).distinct()
    return (
        dated(bad, "hosts", "host", F.col("host"), "add", begins)
        .unionByName(dated(bad, "hosts", "host", F.col("host"), "remove", ends))
        .unionByName(dated(bad.where(digit(4, "host") < 4), "hosts", "host", F.col("host"), "add", ends + 40 * DAY))
        .unionByName(dated(domains, "domains", "domain", F.col("host"), "add", START + digit(5, "host") * 20 * DAY))
        .unionByName(dated(domains, "domains", "domain", F.col("host"), "remove", START + (digit(5, "host") * 20 + 9) * DAY))
        .unionByName(dated(hosts.where(digit(6, "host") < 6), "sections", "prefix", F.concat("host", F.lit("/en")), "add", START + digit(7, "host") * 15 * DAY))
    )


def op1_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """All page captures with the verdict of the lists in force at their fetch time."""
    pages = table(spark, folder, "pages")
    return judge_captures(page_captures(pages), page_lists(pages))


_HOST = r"lower(regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)', 1), '^.*@|\.*(:[0-9]*)?$', ''))"


def _digit(i: int) -> str:
    return f"(strpos('0123456789abcdef', substr(md5(host), {i}, 1)) - 1)"


OP1_SQL = f"""
WITH c AS (SELECT page_id, url, {START} + (page_id * 7919 * 61) % {365 * DAY} AS t, {_HOST} AS host,
    regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*([^?#]*)', 1) AS path FROM pages),
h AS (SELECT DISTINCT host FROM c WHERE host <> ''),
d AS (SELECT DISTINCT array_to_string(string_split(host, '.')[-2:], '.') AS host FROM h),
e AS (
  SELECT 'hosts' AS l, 'host ' || host AS k, TRUE AS adds, {START} + {_digit(2)} * {20 * DAY} AS s FROM h WHERE {_digit(1)} < 8
  UNION ALL SELECT 'hosts', 'host ' || host, FALSE, {START} + {_digit(2)} * {20 * DAY} + ({_digit(3)} + 1) * {8 * DAY} FROM h WHERE {_digit(1)} < 8
  UNION ALL SELECT 'hosts', 'host ' || host, TRUE, {START} + {_digit(2)} * {20 * DAY} + ({_digit(3)} + 1) * {8 * DAY} + {40 * DAY} FROM h WHERE {_digit(1)} < 8 AND {_digit(4)} < 4
  UNION ALL SELECT 'domains', 'domain ' || host, TRUE, {START} + {_digit(5)} * {20 * DAY} FROM d
  UNION ALL SELECT 'domains', 'domain ' || host, FALSE, {START} + ({_digit(5)} * 20 + 9) * {DAY} FROM d
  UNION ALL SELECT 'sections', 'prefix ' || host || '/en', TRUE, {START} + {_digit(7)} * {15 * DAY} FROM h WHERE {_digit(6)} < 6),
i AS (SELECT * FROM (SELECT l, k, adds, s, lead(s) OVER (PARTITION BY l, k ORDER BY s) AS u FROM e) WHERE adds),
k AS (
  SELECT page_id, t, 'host ' || host AS k FROM c
  UNION SELECT page_id, t, 'domain ' || array_to_string(string_split(host, '.')[j:], '.') FROM c, range(1, 9) AS r(j)
    WHERE j <= greatest(len(string_split(host, '.')) - 1, 1)
  UNION SELECT page_id, t, 'prefix ' || host || '/' || string_split(path, '/')[2] FROM c WHERE len(string_split(path, '/')) > 1),
m AS (SELECT page_id, count(*) AS n, min((CASE WHEN k LIKE 'prefix %' THEN -2 WHEN k LIKE 'host %' THEN -1 ELSE 0 END, -length(k), l, k, s)) AS b
  FROM (SELECT k.page_id, k.k, i.l, i.s FROM k JOIN i ON k.k = i.k AND i.s <= k.t AND (i.u IS NULL OR k.t < i.u)) GROUP BY page_id)
SELECT c.page_id, c.url, c.t AS fetched_at, m.n IS NOT NULL AS blocked, coalesce(m.n, 0) AS n_matches,
  m.b[4] AS match_key, m.b[3] AS match_list, m.b[5] AS match_since
FROM c LEFT JOIN m ON c.page_id = m.page_id
"""
