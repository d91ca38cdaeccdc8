import threading

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablewright.operators import anomaly, evaluate, margins, models
from tablewright.plans import training
from tablewright.session import scratch_path


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        k = i % 3
        rows.append((i, float(rng.normal(k * 3, 0.6)), float(rng.normal(-k * 2, 0.6)), "red" if i % 2 else "blue", "abc"[k]))
    return spark.createDataFrame(rows, "row_id long, x double, y double, colour string, kind string").repartition(4)


@pytest.mark.parametrize("algorithm", ["decision_tree", "random_forest", "logistic_regression", "svm"])
def test_each_algorithm_learns(spark, labelled, algorithm):
    result = training.train(labelled, "kind", "row_id", ["x", "y", "colour"], algorithm, cross_validation=False)
    metrics = result.metrics.first()
    assert metrics["n_train"] == 480 and metrics["n_test"] == 120
    assert metrics["accuracy"] > 0.9
    scored = result.scored
    assert scored.count() == 600
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, b: a + b)
    assert scored.where((F.abs(total - 1) > 1e-9) | (F.col("confidence") < 1 / 3)).count() == 0


def test_save_load_delete(spark, labelled):
    registry = training.Registry(spark, scratch_path(spark, "models"))
    result = training.train(labelled, "kind", "row_id", ["x", "y"], "svm", cross_validation=False)
    model_id = registry.save(result, "first")
    again = registry.predict(model_id, labelled.drop("kind"))
    same = again.join(result.scored.select("row_id", F.col("prediction").alias("p")), "row_id").where("prediction = p")
    assert same.count() == 600
    with pytest.raises(ValueError):
        registry.predict(model_id, labelled.drop("x"))
    registry.delete(model_id)
    assert registry.models().count() == 0 and registry.history().count() == 1
    with pytest.raises(KeyError):
        registry.load(model_id)


def test_cross_validation_and_rules(spark, labelled):
    result = training.train(labelled, "kind", "row_id", ["x", "y"], "decision_tree")
    metrics = result.metrics.first()
    assert metrics["folds"] == 5 and metrics["cv_mean"] > 0.9 and metrics["cv_std"] < 0.1
    report = training.tree_report(labelled, "kind", "row_id", ["x", "y"])
    rules = report["rules"].collect()
    assert max(r["depth"] for r in rules) <= 3 and any("x" in r["rule"] or "y" in r["rule"] for r in rules)
    assert abs(report["importance"].agg(F.sum("importance")).first()[0] - 1) < 1e-9


def test_missing_target_is_a_class(spark, labelled):
    gaps = labelled.withColumn("kind", F.when(F.col("row_id") % 10 != 0, F.col("kind")))
    result = training.train(gaps, "kind", "row_id", ["x", "y"], "decision_tree", cross_validation=False)
    assert "Unknown" in result.classes


def test_report_without_cases(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a")], "y string, p string")
    got = {r["class"]: r for r in evaluate.class_report(df, "y", "p").collect()}
    assert got["b"]["precision"] == 0.0 and got["b"]["f1"] == 0.0 and got["a"]["recall"] == 1.0


def test_catalog(spark):
    assert {r["algorithm"] for r in models.algorithms(spark).collect()} == {"decision_tree", "random_forest", "logistic_regression", "svm"}


@pytest.mark.parametrize("rows", [100, 3000])
def test_forest_flags_the_share_asked_for(spark, rows):
    df = spark.range(rows).select(
        F.col("id"), F.sin(F.col("id") * 12.9898).alias("a"), F.when(F.col("id") == 17, 50.0).otherwise(F.cos(F.col("id") * 78.233)).alias("b")
    )
    one = anomaly.isolation_forest(df.repartition(1), ["a", "b"], "id", contamination=0.1).toPandas().sort_values("id")
    seven = anomaly.isolation_forest(df.repartition(7), ["a", "b"], "id", contamination=0.1).toPandas().sort_values("id")
    assert abs(one["is_anomaly"].mean() - 0.1) <= 0.01
    assert np.allclose(one["anomaly_score"], seven["anomaly_score"])
    assert one.loc[one["id"] == 17, "is_anomaly"].iloc[0]


def test_samples_on_a_large_table(spark):
    df = spark.range(400_000).select(F.col("id"), F.rand(1).alias("a"))
    sizes = anomaly.tree_samples(df, "id", ["a"], 400_000).groupBy("tree").count().toPandas()
    assert len(sizes) == 100 and (sizes["count"] == 256).all()


def test_a_key_is_no_class_label(spark):
    df = spark.range(30).selectExpr("id", "string(id) as label")
    with pytest.raises(ValueError, match="more than 10 classes"):
        models.index_target(df, "label", max_classes=10)
    assert len(models.index_target(df, "label", max_classes=30).labels) == 30


@pytest.mark.parametrize("algorithm", ["svm", "decision_tree"])
def test_fits_get_more_tasks_with_the_table(labelled, monkeypatch, algorithm):
    assert models.fit_partitions(50_000, 2) == 8 and models.fit_partitions(36_000_000, 2) > 400
    dealt, layout = [], models.fit_layout

    def seen(df, key, partitions):
        out = layout(df, key, partitions)
        dealt.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(models, "FIT_NUMBERS", 50 * 102)
    monkeypatch.setattr(models, "fit_layout", seen)
    result = training.train(labelled, "kind", "row_id", ["x", "y"], algorithm, cross_validation=False)
    assert dealt == [12] and result.metrics.first()["accuracy"] > 0.9


def test_folds_and_forests_get_more_tasks_with_the_table(spark, monkeypatch):
    df = spark.range(600).selectExpr("id", "double(id % 3) as label_code", "array(double(id % 3), double(id % 7)) as cells")
    df = df.select("id", "label_code", array_to_vector("cells").alias("features"))
    dealt, layout = [], models.fit_layout

    def seen(df, key, partitions):
        out = layout(df, key, partitions)
        dealt.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(models, "FIT_NUMBERS", 60 * 102)
    monkeypatch.setattr(models, "FOREST_TREES", 10)
    monkeypatch.setattr(models, "fit_layout", seen)
    got = models.cross_validate(df, "random_forest", "id", 600, folds=2).first()
    assert dealt == [10] and got["cv_mean"] > 0.99


@pytest.fixture(scope="module")
def points(spark):
    """Three classes that overlap."""
    rng = np.random.default_rng(7)
    rows = [(float(i % 3), rng.normal((i % 3) * 2.0, 1.0, 2).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "label_code double, cells array<double>")
    return df.select("label_code", "cells", array_to_vector("cells").alias("features")).repartition(4).persist()


def test_kernel_machines_keep_no_cosines(spark, points):
    n, kept, stop = points.count(), [0], threading.Event()
    store = spark.sparkContext._jsc.sc()
    before = sum(i.memSize() + i.diskSize() for i in store.getRDDStorageInfo())

    def watch():
        while not stop.wait(0.02):
            kept.append(sum(i.memSize() + i.diskSize() for i in store.getRDDStorageInfo()) - before)

    watcher = threading.Thread(target=watch)
    watcher.start()
    model = models.fit_classifier(points, "svm", n)
    stop.set()
    watcher.join()
    assert 0 < max(kept) < 200 * n  # a hundred cosine features take 800 bytes a row
    scored = model.transform(points)
    assert scored.where("prediction = label_code").count() > 0.8 * n


def test_kernel_machines_are_those_of_linear_svc(points, monkeypatch):
    few = points.limit(600).coalesce(2).persist()
    mapped = models.FourierFeatures(inputCol="features", outputCol="mapped", gamma=0.3, dimensions=2, seed=1).transform(few)
    data = margins.pack(few.select(F.col("label_code").cast("int").alias("label"), "cells"), 2).persist()
    weights, shift = margins.cosine_weights(0.3, 2, 100, 1)
    slopes, intercepts = margins.fit_machines(data, range(3), weights, shift, 1 / 600, 25, 1e-3)
    one = mapped.select((F.col("label_code") == 1).cast("double").alias("label"), "mapped").persist()
    machine = LinearSVC(featuresCol="mapped", maxIter=25, tol=1e-3, regParam=1 / 600, standardization=False).fit(one)
    assert np.allclose(slopes[1], machine.coefficients.toArray(), rtol=1e-6, atol=1e-9)
    assert abs(intercepts[1] - machine.intercept) < 1e-6
    # sums by groups of tasks and of machines are the same
    monkeypatch.setattr(margins, "SUM_ROWS", 1)
    monkeypatch.setattr(margins, "AT_ONCE", 2)
    again, _ = margins.fit_machines(data, range(3), weights, shift, 1 / 600, 25, 1e-3)
    assert np.allclose(again, slopes, rtol=1e-6, atol=1e-9)


def test_moments_of_cosines(spark):
    weights, shift = margins.cosine_weights(0.5, 3, 20, 1)
    cells = np.random.default_rng(3).normal(size=(500, 3))
    df = spark.createDataFrame([(i % 2, row.tolist()) for i, row in enumerate(cells)], "label int, cells array<double>")
    mapped = margins.cosines(cells, weights, shift)
    for parts in (3, 900):  # the latter with empty ones, added up by tasks first
        n, means, spread = margins.moments(margins.pack(df.repartition(parts), 3), parts + 200, weights, shift)
        assert n == 500 and np.allclose(means, mapped.mean(axis=0)) and np.allclose(spread, mapped.std(axis=0, ddof=1))
    equal = margins.pack(df.select("label", F.array(*[F.lit(0.1)] * 3).alias("cells")), 3)
    assert (margins.moments(equal, 1, weights, shift)[2] == 0).all()
