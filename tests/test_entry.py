"""Queries against their SQL at the smallest scale; the slow ones have tests of their own."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from checks.run import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"
SLOW = ("m1_", "m4_", "m5_", "m6_", "m7_", "m11_", "m13_", "m14_cross", "m16_", "m17_", "m18_", "m19_", "m21_", "m22_", "m23_", "m27_", "m28_", "s8_", "v7_")
NAMES = [n for n in entry_points.oracle_sql() if not n.startswith(SLOW)]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = entry_points.queries()[name](spark, FOLDER)
    want = con.sql(entry_points.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    assert got == canonical(want.fetchall(), want.columns)


def test_flagship(spark):
    assert entry_points.entry(spark).count() == 8


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
