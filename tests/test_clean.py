import pytest
from pyspark.sql import functions as F

from tablewright.operators import clean, reduce, transform
from tablewright.plans.cleaning import CleanOptions, preview
from tablewright.plans.cleaning import clean as clean_table


def test_forward_fill_across_stretches(spark):
    # one key holds nearly all rows, so it is cut into several stretches
    rows = [(1, i, float(i) if i % 40 == 0 else None) for i in range(1, 400)] + [(2, i, None) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "k long, at long, v double").repartition(6)
    got = {(r["k"], r["at"]): r["v"] for r in clean.forward_fill(df, "k", "at", ["v"]).collect()}
    for i in range(1, 400):
        assert got[1, i] == (float(i // 40 * 40) if i >= 40 else None)
    assert got[2, 4] is None and len(got) == len(rows)


def test_keep_one(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "k string, at long, v string")
    assert sorted(r["v"] for r in clean.keep_one(df, ["k"], "at", "first").collect()) == ["x", "z"]
    assert sorted(r["v"] for r in clean.keep_one(df, ["k"], "at", "last").collect()) == ["y", "z"]


def test_fills(spark):
    df = spark.createDataFrame([(1, None, "b"), (2, 4.0, "a"), (None, 5.0, "b"), (3, 9.0, "a"), (3, 9.0, None)], "i int, v double, c string")
    mean = clean.fill_mean(df).collect()
    assert mean[2]["i"] == 2.25 and mean[0]["v"] == 6.75 and mean[4]["c"] == "a"
    empty = spark.createDataFrame([(None, None)], "v double, c string")
    assert clean.fill_median(empty).first()["v"] == 0.0 and clean.fill_mode(empty).first()["c"] == "Unknown"


def test_outliers_in_sequence(spark):
    rows = [(float(i), float(i)) for i in range(20)] + [(1000.0, 5.0), (5.0, None)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert clean.remove_outliers(df).count() == 20
    capped = clean.cap_outliers(df, ["a"]).agg(F.max("a")).first()[0]
    assert capped < 1000


def test_bin_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "v double")
    got = {r[0]: r[1] for r in transform.bin_equal_width(df).groupBy("v_discrete").count().collect()}
    assert got == {"Very Low": 3, "Low": 2, "Medium": 2, "High": 2, "Very High": 2}


def test_unknown_strategy_is_refused(spark):
    df = spark.createDataFrame([(1.0,)], "v double")
    with pytest.raises(ValueError):
        clean_table(df, CleanOptions(missing="guess"))


def test_preview_changes_nothing(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (None, "b")], "v double, c string")
    row = preview(df).first()
    assert (row["rows_before"], row["rows_after"], row["duplicates_before"]) == (3, 2, 1)


def test_sample_is_repeatable_and_exact(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("s"))
    one = reduce.stratified_sample(df.repartition(1), "s", ["id"], 300)
    seven = reduce.stratified_sample(df.repartition(7), "s", ["id"], 300)
    assert sorted(r["id"] for r in one.collect()) == sorted(r["id"] for r in seven.collect())
    assert one.groupBy("s").count().where("s = 'hot'").first()["count"] == 100
    assert reduce.uniform_sample(df, ["id"], 100).count() == 100


def test_pca_properties(spark):
    df = spark.range(300).select(
        (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 17 * 2 + F.col("id") % 5).cast("double").alias("b"), (F.col("id") % 3).cast("double").alias("c"), F.lit("t").alias("t")
    )
    out = reduce.pca(df)
    assert out.columns[0] == "t" and out.columns[1] == "PC1"
    moments = out.agg(*[F.avg(c).alias(c) for c in out.columns[1:]]).first()
    assert all(abs(m) < 1e-9 for m in moments)
    shares = [r["explained"] for r in reduce.pca_report(df).collect()]
    assert shares == sorted(shares, reverse=True) and sum(shares) > 0.95


def test_dictionary_codes_follow_first_appearance(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None), (5, "a"), (6, "b")], "n long, c string")
    got = {r["n"]: r["c_encoded"] for r in reduce.dictionary_encode(df, "n").collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 2, 5: 1, 6: 0}


def test_key_survives_pca(spark):
    df = spark.range(50).select(F.col("id"), *[(F.col("id") * i % 11).cast("double").alias(f"v{i}") for i in (2, 3, 5)])
    out = reduce.reduce_table(df, "id", reduce.ReduceOptions(pca=True))
    assert dict(out.dtypes)["id"] == "bigint" and out.agg(F.count_distinct("id")).first()[0] == 50


def test_reports_of_a_cleaning_run(spark):
    from tablewright.operators.reduce import ReduceOptions
    from tablewright.plans.cleaning import CleanOptions, clean_with_reports

    rows = [(i, float(i % 7) if i % 5 else None, "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, v double, c string")
    run = clean_with_reports(df, CleanOptions(key="k", reduce=ReduceOptions(feature_selection=False, pca=False, sampling=False, compress=True)))
    missing = [{r["column"]: r["n_missing"] for r in found["missing"].collect()} for found in (run.before, run.after)]
    assert missing[0]["v"] == 12 and missing[1]["v"] == 0
    assert {r["value"]: r["code"] for r in run.dictionaries["c"].collect()} == {"a": 0, "b": 1}
    assert run.reduction.first()["rows_after"] == 60 and run.aggregate is None
