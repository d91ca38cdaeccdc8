"""Training, reporting, saving and applying a classifier end to end."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.scalars import as_column, clean_target
from tablewright.operators import evaluate as E
from tablewright.operators import models as M
from tablewright.operators.prepare import (
    IDENTIFIER_RATIO,
    adaptive_split,
    fit_feature_pipeline,
    stratified_split,
    training_features,
)
from tablewright.operators.profile import _rows, fit_distinct
from tablewright.operators.roles import IDENTIFIER_NAME
from tablewright.sources.tables import read_csv

REGISTRY_SCHEMA = (
    "model_id string, name string, algorithm string, target string, features array<string>, classes array<string>, "
    "accuracy double, cv_mean double, cv_std double, n_train long, n_test long, path string, action string, at_ms long"
)


KEY, TARGET = "row_key", "target_class"


@dataclass
class Trained:
    """A fitted classifier with its evaluation."""

    model: PipelineModel
    algorithm: str
    target: str
    features: list[str]
    classes: list[str]
    scored: DataFrame
    metrics: DataFrame
    report: DataFrame
    confusion: DataFrame
    importance: DataFrame


def _kept(df: DataFrame) -> DataFrame:
    """A report of a few rows, computed now and independent of the tables behind it."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def usable_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Leave out numeric columns that are row identifiers by name and uniqueness."""
    named = [
        c for c in features if M.re.search(IDENTIFIER_NAME, c.lower()) and c in df.columns and df.schema[c].dataType.simpleString() != "string"
    ]
    distinct = fit_distinct(df, named)
    total = df.count() if named else 0
    return [c for c in features if c not in named or not distinct[c] > IDENTIFIER_RATIO * total]


def train(
    df: DataFrame,
    target: str,
    key: str,
    features: Sequence[str] | None = None,
    algorithm: str = "random_forest",
    cross_validation: bool = True,
    kernel: str = "rbf",
    depth: int = M.TREE_DEPTH,
    adaptive: bool = False,
    fit_on: str = "train",
    partitions: int = M.FIT_PARTITIONS,
) -> Trained:
    """Fit on a stratified share of the rows, evaluate on the rest, predict all rows.

    ``partitions``: tasks per fitting step, at least; large tables get more, by their rows and features.
    """
    spark = df.sparkSession
    names = usable_features(df, features or training_features(df.drop(key), target))
    prepare, used = fit_feature_pipeline(df, names)
    # key and target go under names of their own: theirs may hold dots
    labelled = prepare.transform(df).select(as_column(key).alias(KEY), clean_target(df, target).alias(TARGET), "features")
    indexer = M.index_target(labelled, TARGET)
    classes = list(indexer.labels)
    ready = indexer.transform(labelled).select(KEY, TARGET, "features", "label_code")
    split = adaptive_split(ready, TARGET, [KEY]) if adaptive else stratified_split(ready, TARGET, [KEY])
    partitions = M.fit_partitions(ready.count(), len(used), partitions)
    split = M.fit_layout(split, KEY, partitions).persist()
    sizes = split.groupBy("is_test").count().collect()
    n_train = sum(r["count"] for r in sizes if not r["is_test"])
    n_test = sum(r["count"] for r in sizes if r["is_test"])
    fitted_on = split if fit_on == "all" else split.where(~F.col("is_test"))
    fitted = M.fit_classifier(fitted_on, algorithm, n_train, depth, kernel)
    tested = M.apply_model(fitted, split.where("is_test"), classes).select(TARGET, "prediction").persist()
    metrics = E.accuracy(tested, TARGET, "prediction").select(
        "accuracy", F.lit(n_train).cast("long").alias("n_train"), F.lit(n_test).cast("long").alias("n_test")
    )
    report, confusion = E.class_report(tested, TARGET, "prediction"), E.confusion(tested, TARGET, "prediction")
    if cross_validation:
        pool = split if n_train + n_test > 50 else split.where(~F.col("is_test"))
        pool_rows = n_train + n_test if n_train + n_test > 50 else n_train
        # one row on each side
        metrics = metrics.crossJoin(M.cross_validate(pool, algorithm, KEY, pool_rows, kernel=kernel, partitions=partitions))
    else:
        metrics = metrics.select(
            "*",
            F.lit(0).alias("folds"),
            F.lit(None).cast("double").alias("cv_mean"),
            F.lit(None).cast("double").alias("cv_std"),
        )
    metrics, report, confusion = _kept(metrics), _kept(report), _kept(confusion)  # rows by class, at most classes squared
    tested.unpersist()
    split.unpersist()
    importance = M.feature_importance(spark, fitted, used)
    model = PipelineModel([*prepare.stages, *(fitted.stages if isinstance(fitted, PipelineModel) else [fitted])])
    result = Trained(model, algorithm, target, used, classes, df, metrics, report, confusion, importance)
    result.scored = predict(result.model, df, used, classes)
    return result


def train_from_file(spark: SparkSession, path: str, target: str, key: str, **options) -> Trained:
    """Read a CSV file and train on it."""
    return train(read_csv(spark, path), target, key, **options)


def tree_report(
    df: DataFrame, target: str, key: str, features: Sequence[str] | None = None, fit_on: str = "train"
) -> dict[str, DataFrame]:
    """A shallow tree: accuracy and sizes, readable rules, feature importance, predictions."""
    trained = train(
        df,
        target,
        key,
        features,
        "decision_tree",
        cross_validation=False,
        depth=M.REPORT_DEPTH,
        adaptive=True,
        fit_on=fit_on,
    )
    tree = trained.model.stages[-1]
    return {
        "metrics": trained.metrics,
        "rules": M.tree_rules(df.sparkSession, tree, trained.features),
        "importance": trained.importance,
        "scored": trained.scored,
    }


def predict(model: PipelineModel, df: DataFrame, features: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """Label every row; also works on a streaming DataFrame."""
    absent = [f for f in features if f not in df.columns]
    if absent:
        raise ValueError(f"missing features: {absent}")
    scored = M.apply_model(model, df, classes)
    return scored.select(*[F.col(f"`{c}`") for c in df.columns], "prediction", "probabilities", "confidence")


class Registry:
    """Saved models in a shared folder: pipelines next to an append-only log.

    Deleting a model appends a line; nothing that is being read is rewritten.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    @property
    def log_path(self) -> str:
        return f"{self.folder}/registry"

    def _append(self, row: tuple) -> None:
        _rows(self.spark, [row], REGISTRY_SCHEMA).coalesce(1).write.mode("append").parquet(self.log_path)

    def save(self, trained: Trained, name: str) -> str:
        """Store the pipeline, then its line, which holds the final scores."""
        model_id = uuid.uuid4().hex
        path = f"{self.folder}/pipelines/{model_id}"
        trained.model.write().overwrite().save(path)
        m = trained.metrics.first()
        self._append(
            (
                model_id,
                name,
                trained.algorithm,
                trained.target,
                trained.features,
                trained.classes,
                m["accuracy"],
                m["cv_mean"],
                m["cv_std"],
                m["n_train"],
                m["n_test"],
                path,
                "saved",
                int(time.time() * 1000),
            )
        )
        return model_id

    def history(self) -> DataFrame:
        """Every training run, also of models deleted since."""
        return self.spark.read.schema(REGISTRY_SCHEMA).parquet(self.log_path).where("action = 'saved'")

    def models(self) -> DataFrame:
        """Models that have not been deleted."""
        log = self.spark.read.schema(REGISTRY_SCHEMA).parquet(self.log_path)
        return current_models(log)

    def details(self, model_id: str) -> DataFrame:
        return self.models().where(F.col("model_id") == model_id)

    def delete(self, model_id: str) -> None:
        row = self.details(model_id).first()
        if row is None:
            raise KeyError(model_id)
        self._append((*row[:-2], "deleted", int(time.time() * 1000)))

    def load(self, model_id: str) -> tuple[PipelineModel, list[str], list[str]]:
        """The pipeline, its features and its classes."""
        row = self.details(model_id).first()
        if row is None:
            raise KeyError(model_id)
        return PipelineModel.load(row["path"]), list(row["features"]), list(row["classes"])

    def predict(self, model_id: str, df: DataFrame) -> DataFrame:
        model, features, classes = self.load(model_id)
        return predict(model, df, features, classes)


def current_models(log: DataFrame) -> DataFrame:
    """Log lines of models without a deletion line."""
    deleted = log.where("action = 'deleted'").select("model_id")
    return log.where("action = 'saved'").join(deleted, "model_id", "left_anti").select(*log.columns)
