"""Column roles and what is built on them."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from checks import common
from checks.common import DATES, NUMERIC, STRING, each, table
from checks.profile_checks import corr_sql, q
from tablewright.operators import profile as P
from tablewright.operators import roles as R


def query(name, sql, digits=6):
    """Ratios are small, so they are compared to six digits."""
    return common.query(name, sql, digits)


def r(expression, digits=6):
    return common.r(expression, digits)


ID_NAME = "id$|^id|_id$|^id_|no$|^no|number$|^number"
KEY_NAME = "_id$|^id_|code$|^code|ref$|^ref|key$|^key|partner.*id|store.*id|customer.*id"


def facts(source: str) -> str:
    """Per-column counts the role rules need."""
    base = """SELECT '{c}' AS "column", '%s' AS kind, count(DISTINCT {c}) AS n_distinct, count(*) AS n_rows,
    count(DISTINCT {c}) / count(*) AS ratio, %s AS avg_length, %s AS max_length, %s AS url_share, %s AS email_share,
    %s AS lo, %s AS hi FROM """ + source
    text = (
        "avg(length({c}))",
        "CAST(max(length({c})) AS BIGINT)",
        "avg(CASE WHEN contains({c}, 'http') OR contains({c}, 'www.') THEN 1.0 ELSE 0.0 END)",
        "avg(CASE WHEN contains({c}, '@') AND contains({c}, '.') THEN 1.0 ELSE 0.0 END)",
        "min({c})",
        "max({c})",
    )
    none = ("NULL",) * 4
    span = ("CAST(min({c}) AS VARCHAR)", "CAST(max({c}) AS VARCHAR)")
    parts = [each(NUMERIC.get(source, []), base % ("numeric", *none, *span))] if NUMERIC.get(source) else []
    if STRING.get(source):
        parts.append(each(STRING[source], base % ("string", *text)))
    if source in DATES:
        parts.append(each(DATES[source], base % ("datetime", *none, *span)))
    return " UNION ALL ".join(parts)


def rich_sql(source: str) -> str:
    physical = (
        "CASE kind WHEN 'numeric' THEN 'Numeric' WHEN 'datetime' THEN 'DateTime' ELSE "
        "CASE WHEN n_distinct <= 50 AND (ratio < 0.5 OR n_distinct = 2) THEN 'Categorical' ELSE 'Text' END END"
    )
    role = f"""CASE WHEN physical = 'Numeric' AND ratio > 0.95 AND regexp_matches("column", '{ID_NAME}') THEN 'identifier'
    WHEN physical = 'Numeric' AND regexp_matches("column", '{KEY_NAME}') AND ratio > 0.01 AND ratio < 0.8 THEN 'foreign_key'
    WHEN physical = 'Numeric' THEN 'numeric' WHEN physical = 'Categorical' AND n_distinct = 2 THEN 'binary'
    WHEN physical = 'Categorical' THEN 'categorical' WHEN physical = 'DateTime' THEN 'date'
    WHEN url_share >= 0.5 OR email_share >= 0.5 OR avg_length > 50 THEN 'string' ELSE 'categorical' END"""
    subtype = """CASE role WHEN 'identifier' THEN CASE WHEN ratio = 1 THEN 'primary_key' ELSE 'unique_identifier' END
    WHEN 'foreign_key' THEN 'foreign_key'
    WHEN 'numeric' THEN CASE WHEN regexp_matches("column", 'price|amount|total|balance|income|cost|salary') THEN 'monetary'
      WHEN regexp_matches("column", 'age|year|count|quantity|weight|height') THEN 'measured_value'
      WHEN regexp_matches("column", 'percent|rate|ratio|score') THEN 'percentage_or_ratio' ELSE 'continuous' END
    WHEN 'date' THEN 'YYYY-MM-DD'
    WHEN 'string' THEN CASE WHEN url_share >= 0.5 THEN 'url' WHEN email_share >= 0.5 THEN 'email' ELSE 'long_text' END
    WHEN 'binary' THEN CASE WHEN lower(lo) IN ('yes','no','y','n') OR lower(hi) IN ('yes','no','y','n') THEN 'yes_no'
      WHEN lower(lo) IN ('true','false','t','f') OR lower(hi) IN ('true','false','t','f') THEN 'true_false'
      WHEN lower(lo) IN ('male','female','m','f') OR lower(hi) IN ('male','female','m','f') THEN 'gender' ELSE 'custom_binary' END
    ELSE CASE WHEN physical = 'Text' THEN 'text_based' WHEN n_distinct <= 10 THEN 'low_cardinality' ELSE 'moderate_cardinality' END END"""
    return (
        f"(SELECT *, {subtype} AS subtype FROM (SELECT *, {role} AS role FROM (SELECT *, {physical} AS physical FROM ({facts(source)}))))"
    )


CONFIDENCE = "CASE role WHEN 'identifier' THEN least(0.95, ratio + 0.05) WHEN 'foreign_key' THEN 0.9 END"


def roles_sql(source: str) -> str:
    return f"""SELECT "column", role, subtype, {r(CONFIDENCE)} AS confidence, n_distinct, {r('ratio')} AS ratio FROM {rich_sql(source)}"""


def roles(spark, folder, name, **options):
    return R.column_roles(table(spark, folder, name), **options)


for _name in ("lineitem", "orders", "events", "part", "customer", "documents", "labels"):

    @query(f"t1_roles_{_name}", roles_sql(_name))
    def _(spark, folder, _name=_name):
        return roles(spark, folder, _name).select("column", "role", "subtype", "confidence", "n_distinct", "ratio")


@query(
    "t1a_identifiers",
    f"""SELECT "column", subtype, n_distinct, {r('ratio')} AS ratio, {r(CONFIDENCE)} AS confidence FROM {rich_sql('events')} WHERE role = 'identifier'""",
)
def _(spark, folder):
    return R.identifiers(roles(spark, folder, "events"))


@query(
    "t1b_foreign_keys",
    f"""SELECT "column", n_distinct, {r('ratio')} AS ratio, {r(CONFIDENCE)} AS confidence FROM {rich_sql('lineitem')} WHERE role = 'foreign_key'""",
)
def _(spark, folder):
    return R.foreign_keys(roles(spark, folder, "lineitem"))


@query(
    "t1c_numeric_subtypes",
    f"""SELECT r."column", subtype, n_distinct > 20 AS is_continuous, mean, std, min, max, median FROM {rich_sql('lineitem')} r JOIN ("""
    + each(
        NUMERIC["lineitem"],
        f"""SELECT '{{c}}' AS "column", {r('avg({c})')} AS mean, {r('stddev_samp(CAST({c} AS DOUBLE))')} AS std, {r('min({c})')} AS min, {r('max({c})')} AS max, {r(q('{c}', 0.5))} AS median FROM lineitem""",
    )
    + """) s ON r."column" = s."column" WHERE role = 'numeric'""",
)
def _(spark, folder):
    return R.numeric_roles(table(spark, folder, "lineitem"), roles(spark, folder, "lineitem"))


@query(
    "t1d_binary",
    f"""SELECT "column", subtype, lo AS first_value, hi AS last_value, subtype AS value_kind FROM {rich_sql('lineitem')} WHERE role = 'binary'""",
)
def _(spark, folder):
    return R.binary_roles(roles(spark, folder, "lineitem"))


def category_flags(source, columns):
    return each(
        columns,
        f"""SELECT '{{c}}' AS "column", bool_or(regexp_matches(lower(v), 'low|medium|high|small|large|good|better|best')) AS is_ordinal, max(CASE WHEN rn = 1 THEN v END) AS mode
        FROM (SELECT {{c}} AS v, row_number() OVER (ORDER BY count(*) DESC, {{c}}) AS rn FROM {source} GROUP BY {{c}}) WHERE rn <= 10""",
    )


for _name in ("orders", "part"):

    @query(
        f"t1e_categorical_{_name}",
        f"""SELECT r."column", subtype, n_distinct, is_ordinal, mode FROM {rich_sql(_name)} r JOIN ({category_flags(_name, STRING[_name])}) f ON r."column" = f."column" WHERE role = 'categorical'""",
    )
    def _(spark, folder, _name=_name):
        return R.categorical_roles(table(spark, folder, _name), roles(spark, folder, _name))


@query("t1f_dates", f"""SELECT "column", subtype, true AS has_time FROM {rich_sql('events')} WHERE role = 'date'""")
def _(spark, folder):
    return R.date_roles(roles(spark, folder, "events", order_by="event_id"))


@query(
    "t1g_text_documents",
    f"""SELECT "column", subtype, {r('avg_length')} AS avg_length, max_length FROM {rich_sql('documents')} WHERE role = 'string'""",
)
def _(spark, folder):
    return R.text_roles(roles(spark, folder, "documents"))


@query(
    "t1g_text_pages",
    f"""SELECT 'url' AS "column", 'url' AS subtype, {r('avg(length(url))')} AS avg_length, CAST(max(length(url)) AS BIGINT) AS max_length FROM pages""",
)
def _(spark, folder):
    df = table(spark, folder, "pages").select("page_id", "url")
    return R.text_roles(R.column_roles(df, order_by="page_id"))


@query(
    "t1h_boolean",
    """SELECT 'large' AS "column", 'binary' AS role, 'boolean' AS subtype, count(DISTINCT l_quantity > 25) AS n_distinct FROM lineitem""",
)
def _(spark, folder):
    df = table(spark, folder, "lineitem").select((F.col("l_quantity") > 25).alias("large"))
    return R.column_roles(df).select("column", "role", "subtype", "n_distinct")


@query(
    "t1i_unsupported",
    """SELECT 'embedding' AS "column", 'categorical' AS role, 'unknown' AS subtype, count(DISTINCT embedding) AS n_distinct FROM embeddings""",
)
def _(spark, folder):
    df = table(spark, folder, "embeddings").select("embedding")
    return R.column_roles(df).select("column", "role", "subtype", "n_distinct")


def simple_sql(source):
    role = """CASE WHEN kind = 'numeric' AND ratio > 0.95 THEN 'identifier' WHEN kind = 'numeric' AND n_distinct = 2 THEN 'binary' WHEN kind = 'numeric' THEN 'numeric'
    WHEN kind = 'datetime' THEN 'date' WHEN n_distinct = 2 THEN 'binary' WHEN ratio > 0.95 THEN 'identifier' WHEN n_distinct <= 50 THEN 'categorical' ELSE 'string' END"""
    subtype = """CASE WHEN kind = 'numeric' THEN CASE role WHEN 'identifier' THEN 'unique_identifier' WHEN 'binary' THEN 'numeric_binary' ELSE 'continuous' END
    WHEN kind = 'datetime' THEN 'datetime' ELSE CASE role WHEN 'binary' THEN 'string_binary' WHEN 'identifier' THEN 'string_identifier' WHEN 'categorical' THEN 'low_cardinality' ELSE 'text' END END"""
    return f"""SELECT "column", role, {subtype} AS subtype, CASE WHEN role = 'identifier' THEN {r('ratio')} END AS confidence FROM (SELECT *, {role} AS role FROM ({facts(source)}))"""


for _name in ("lineitem", "events", "documents", "labels"):

    @query(f"t2_simple_roles_{_name}", simple_sql(_name))
    def _(spark, folder, _name=_name):
        return roles(spark, folder, _name, rules="simple").select("column", "role", "subtype", "confidence")


PAIRS = {
    "numeric_binary": ("0", "1"),
    "yes_no": ("Yes", "other"),
    "true_false": ("m", "f"),
    "gender": ("Male", "x"),
    "status": ("active", "z"),
    "custom_binary": ("red", "blue"),
}


@query(
    "t3_binary_subtypes",
    " UNION ALL ".join(
        f"SELECT '{kind}' AS value_kind, '{min(pair)}' AS lo, '{max(pair)}' AS hi, count(*) AS n FROM events" for kind, pair in PAIRS.items()
    ),
)
def _(spark, folder):
    # two-valued columns derived from the parity of the event
    even = F.col("event_id") % 2 == 0
    df = table(spark, folder, "events").select(
        *[F.when(even, a).otherwise(b).alias(kind) for kind, (a, b) in PAIRS.items()]
    )
    profile = P.column_profile(df)
    return profile.select(
        R.binary_subtype("first_value", "last_value").alias("value_kind"),
        F.col("first_value").alias("lo"),
        F.col("last_value").alias("hi"),
        (F.col("n_rows") - F.col("n_missing")).alias("n"),
    )


LISTINGS = {
    "text": ("documents", ("string",)),
    "foreign_key": ("lineitem", ("foreign_key",)),
    "date": ("orders", ("date",)),
    "categorical": ("lineitem", ("categorical", "binary")),
    "binary": ("lineitem", ("binary",)),
    "primary_key": ("events", ("identifier",)),
}
for _kind, (_name, _wanted) in LISTINGS.items():

    @query(
        f"t4_{_kind}_columns",
        f"""SELECT "column", role, subtype, n_distinct, {r('ratio')} AS ratio FROM {rich_sql(_name)} WHERE role IN ({', '.join(f"'{w}'" for w in _wanted)})""",
    )
    def _(spark, folder, _name=_name, _wanted=_wanted):
        return R.role_listing(roles(spark, folder, _name), *_wanted)


@query(
    "t5_role_counts",
    "SELECT role, count(n_distinct) AS n_columns FROM (VALUES "
    + ", ".join(f"('{x}')" for x in R.ROLES)
    + f") v(role) LEFT JOIN {rich_sql('lineitem')} USING (role) GROUP BY role",
)
def _(spark, folder):
    return R.role_counts(roles(spark, folder, "lineitem"))


@query("t6_physical_kinds", f"""SELECT "column", physical FROM {rich_sql('documents')}""")
def _(spark, folder):
    return roles(spark, folder, "documents").select("column", "physical")


@query(
    "d3_binary_summary",
    each(
        ["quality", "toxic"],
        """SELECT '{c}' AS "column", CAST(min({c}) AS VARCHAR) AS first_value, CAST(max({c}) AS VARCHAR) AS last_value, 'numeric_binary' AS value_kind, count({c}) AS n_present, count(*) - count({c}) AS n_missing FROM labels""",
    ),
)
def _(spark, folder):
    profile = P.column_profile(table(spark, folder, "labels"))
    return profile.where("n_distinct = 2").select(
        "column",
        "first_value",
        "last_value",
        R.binary_subtype("first_value", "last_value").alias("value_kind"),
        (F.col("n_rows") - F.col("n_missing")).alias("n_present"),
        "n_missing",
    )


@query(
    "d4_identifier_summary",
    f"""SELECT "column", subtype, n_distinct, {r('ratio')} AS ratio, {r(CONFIDENCE)} AS confidence FROM {rich_sql('documents')} WHERE role = 'identifier'""",
)
def _(spark, folder):
    return R.identifiers(roles(spark, folder, "documents"))


@query(
    "d27_analyze",
    f"""SELECT r."column", role, n_distinct, s.mean, s.std, s.median FROM {rich_sql('lineitem')} r LEFT JOIN ("""
    + each(
        NUMERIC["lineitem"],
        f"""SELECT '{{c}}' AS "column", {r('avg({c})')} AS mean, {r('stddev_samp(CAST({c} AS DOUBLE))')} AS std, {r(q('{c}', 0.5))} AS median FROM lineitem""",
    )
    + """) s ON r."column" = s."column" AND r.role NOT IN ('identifier', 'binary')""",
)
def _(spark, folder):
    from tablewright.plans.analyze import analyze

    return analyze(table(spark, folder, "lineitem"))["columns"].select(
        "column", "role", "n_distinct", "mean", "std", "median"
    )


@query(
    "d27_analyze_correlation",
    " UNION ALL ".join(
        corr_sql(a, b, "events") for a, b in combinations(["user_id", "value"], 2)
    ),
    digits=4,
)
def _(spark, folder):
    from tablewright.plans.analyze import analyze

    return analyze(table(spark, folder, "events"))["correlation"]


@query(
    "t1f_dates_mixed_formats",
    """SELECT 'order_date' AS "column", CASE WHEN 2 * count_if(event_id % 3 = 0) >= count(*) THEN 'MM/DD/YYYY_or_DD/MM/YYYY' ELSE 'YYYY-MM-DD' END AS subtype,
    2 * count_if(event_id % 5 = 0) >= count(*) AS has_time FROM events""",
)
def _(spark, folder):
    day = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "MM/dd/yyyy")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    text = F.when(F.col("event_id") % 5 == 0, F.concat(day, F.lit(" 10:00"))).otherwise(day)
    found = R._sniffed(table(spark, folder, "events").select(text.alias("order_date")), ["order_date"], None)
    return found.select("column", F.col("date_format").alias("subtype"), "has_time")


@query(
    "t1_roles_estimated",
    f"""SELECT "column", role, lo AS first_value, hi AS last_value FROM {rich_sql('lineitem')} WHERE role = 'binary'""",
)
def _(spark, folder):
    roles = R.column_roles(table(spark, folder, "lineitem"), exact=False)
    return roles.where("role = 'binary'").select("column", "role", "first_value", "last_value")
