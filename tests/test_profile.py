import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import charts, profile, quality, roles
from tablewright.operators.profile import correlation


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(1, 5.0, None, "b", True), (2, 5.0, None, "a", False), (3, 5.0, None, "b", True), (4, None, None, "a", None)]
    return spark.createDataFrame(rows, "row_id long, k double, e double, c string, f boolean")


def by_column(df):
    return {r["column"]: r.asDict() for r in df.collect()}


def test_profile_edges(edges):
    got = by_column(profile.column_profile(edges))
    assert got["c"]["mode"] == "a" and got["c"]["mode_count"] == 2  # smallest of tied values
    assert got["e"]["n_missing"] == 4 and got["e"]["mean"] is None and got["e"]["n_distinct"] == 0
    assert got["k"]["std"] == 0.0 and got["row_id"]["n_singleton"] == 4


def test_single_row_and_empty(spark):
    one = spark.createDataFrame([(7.0, "x")], "v double, t string")
    assert by_column(profile.numeric_summary(one))["v"]["std"] == 0.0
    empty = one.limit(0)
    assert by_column(profile.column_profile(empty))["v"]["n_rows"] == 0
    assert by_column(profile.iqr_outliers(empty))["v"]["n_outliers"] == 0
    assert profile.duplicate_rows(empty).first()["n_duplicates"] == 0
    assert by_column(roles.column_roles(empty)).keys() == {"v", "t"}


def test_correlation_of_constant_is_null(edges):
    got = {(r[0], r[1]): r[2] for r in profile.correlation(edges, ["row_id", "k", "e"]).collect()}
    assert got == {("row_id", "k"): None, ("row_id", "e"): None, ("k", "e"): None}


def test_estimates_agree_with_exact(spark):
    df = spark.range(20_000).select((F.col("id") % 1000).cast("double").alias("v"))
    assert abs(by_column(profile.distinct_counts(df, exact=False))["v"]["n_distinct"] - 1000) < 40
    assert abs(by_column(profile.numeric_summary(df, exact=False))["v"]["median"] - 499.5) < 15


def test_roles(edges):
    got = by_column(roles.column_roles(edges))
    assert got["row_id"]["subtype"] == "primary_key" and got["f"]["subtype"] == "boolean"
    assert got["c"]["role"] == "binary"


def test_ordinal_flag(spark):
    df = spark.createDataFrame([(w,) for w in ["Low", "High", "Medium"] * 5], "size_class string")
    assert roles.categorical_roles(df, roles.column_roles(df)).first()["is_ordinal"]


def test_first_three_values_decide_text_kind(spark):
    rows = [(i, f"http://host/{i}" if i < 3 else f"plain words {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "n long, link string")
    assert by_column(roles.column_roles(df))["link"]["subtype"] == "text_based"
    assert by_column(roles.column_roles(df, order_by="n"))["link"]["subtype"] == "url"


def test_results_do_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") * 7 % 13).cast("double").alias("v"))
    one, seven = df.repartition(1), df.repartition(7)
    assert profile.iqr_outliers(one).collect() == profile.iqr_outliers(seven).collect()


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "v double")
    assert [r["count"] for r in charts.histogram(df, "v").orderBy("bin").collect()] == [1] * 9 + [2]
    assert [r["count"] for r in charts.histogram(df, "v", drop_max=True).orderBy("bin").collect()] == [1] * 10


def test_quality_score(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a long, b string")
    row = quality.quality_score(df).first()
    assert (row["missing_cells"], row["duplicates"]) == (2, 1) and row["score"] == 0.0
    assert quality.duplicate_records(df).first()["n_records"] == 2


def test_long_texts_are_told_apart_behind_their_start(spark):
    start = "<html>" * 40
    rows = [(start + x, n) for n, x in enumerate("bbaaccd")] + [(None, 9), ("short", 10)]
    df = spark.createDataFrame(rows, "`page.html` string, n int")
    got = by_column(profile.column_profile(df))
    page = got["page.html"]
    assert (page["n_distinct"], page["n_singleton"], page["mode_count"]) == (5, 2, 2)
    assert page["mode"] == start + "a" and page["first_value"] == start + "a" and page["last_value"] == "short"
    assert got["n"]["mode"] == "0" and got["n"]["last_value"] == "10"
    top = {r["rank"]: (r["value"], r["count"]) for r in profile.top_values(df, ["page.html"], 4).collect()}
    assert top == {1: (start + "a", 2), 2: (start + "b", 2), 3: (start + "c", 2), 4: (start + "d", 1)}
    assert profile.fit_modes(df, ["page.html", "n"]) == {"page.html": start + "a", "n": "0"}
    assert profile.fit_modes(df.where("false"), ["page.html"]) == {"page.html": None}


def test_correlation_of_many_columns_with_gaps(spark):
    """Three hundred columns, some with gaps, constants, large means and no rows in common with others."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(400, 20))
    x = base[:, rng.integers(0, 20, 300)] + rng.normal(size=(400, 300))
    x[:, 7] = 3.0
    x[:, 8] = x[:, 9] * 1e-3 + 1e6
    x[rng.random((400, 300)) < np.where(np.arange(300) % 3 == 0, 0.3, 0.0)] = np.nan
    x[:200, 30], x[200:, 33] = np.nan, np.nan
    x[5:, 36] = np.nan
    x[:5, 36] = 2.0
    names = [f"f.{i}" for i in range(300)]
    pdf = pd.DataFrame(x, columns=names)
    got = correlation(spark.createDataFrame(pdf).repartition(6)).toPandas()
    assert len(got) == 300 * 299 // 2
    want = pdf.corr(min_periods=1).to_numpy()
    mine = np.full((300, 300), np.nan)
    at = {c: i for i, c in enumerate(names)}
    mine[got.column1.map(at), got.column2.map(at)] = got.correlation.astype(float)
    upper = np.triu_indices(300, 1)
    unknown = np.isnan(want[upper]) | (np.abs(want[upper]) > 1)
    assert np.allclose(mine[upper][~unknown], want[upper][~unknown], atol=1e-7)
    assert np.isnan(mine[7, 8:]).all() and np.isnan(mine[36, 37:]).all() and np.isnan(mine[30, 33])
    assert correlation(spark.createDataFrame(pdf).limit(0).select("`f.0`", "`f.1`")).collect()[0]["correlation"] is None
