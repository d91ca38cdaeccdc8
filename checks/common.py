"""Helpers shared by the check modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NUMERIC = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
    "events": ["event_id", "user_id", "value"],
    "part": ["p_partkey", "p_size", "p_retailprice"],
    "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
    "documents": ["doc_id", "n_chars"],
    "labels": ["doc_id", "quality", "toxic"],
}
STRING = {
    "lineitem": ["l_returnflag", "l_linestatus"],
    "orders": ["o_orderstatus", "o_orderpriority"],
    "events": ["event_type", "props"],
    "part": ["p_name", "p_brand", "p_type"],
    "customer": ["c_name", "c_mktsegment"],
    "documents": ["text", "lang", "source"],
    "labels": [],
}
DATES = {"lineitem": ["l_shipdate"], "orders": ["o_orderdate"], "events": ["ts"]}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tidy(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round doubles and widen integers, so both engines print the same values."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, digits: int = 4):
    """Register a query, its SQL, and the rounding both use."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: tidy(fn(spark, folder), digits)
        if sql is not None:
            ORACLES[name] = " ".join(sql.split())
        return fn

    return wrap


def r(expression: str, digits: int = 4) -> str:
    """SQL rounding that matches :func:`tidy`."""
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + 0.0)"


def each(columns, template: str) -> str:
    """One SELECT per column, glued with UNION ALL; ``{c}`` is the column name."""
    return " UNION ALL ".join("(" + template.replace("{c}", c) + ")" for c in columns)


# Defects injected into clean tables, the same expression on both sides.

EVENTS_GAPS = (
    "(SELECT event_id, user_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type, "
    "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events)"
)


def events_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id",
        "user_id",
        F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
    )


EVENTS_COPIES = (
    "(SELECT event_id, user_id, event_type, value FROM events UNION ALL "
    "SELECT event_id, user_id, event_type, value FROM events WHERE event_id % 10 = 0)"
)


def events_copies(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    return events.unionByName(events.where("event_id % 10 = 0"))


ORDERS_SPIKES = (
    "(SELECT o_orderkey, o_custkey, "
    "CASE WHEN o_orderkey % 100 = 0 THEN o_totalprice * 10 ELSE o_totalprice END AS o_totalprice, "
    "o_orderstatus, o_orderpriority FROM orders)"
)


def orders_spikes(spark: SparkSession, folder: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 100 == 0, F.col("o_totalprice") * 10).otherwise(F.col("o_totalprice"))
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", price.alias("o_totalprice"), "o_orderstatus", "o_orderpriority"
    )
