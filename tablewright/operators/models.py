"""Classifiers: building, fitting, explaining and applying them."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Model, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.scalars import as_column
from tablewright.operators import margins
from tablewright.operators.margins import CHUNK_ROWS, cosine_weights, cosines
from tablewright.operators.prepare import fold_numbers
from tablewright.operators.profile import _rows

# Model parameters.
SEED = 42
TREE_DEPTH, REPORT_DEPTH, RULE_DEPTH = 10, 5, 3
MIN_LEAF = 2
FOREST_TREES = 100
LOGISTIC_ITERATIONS, LOGISTIC_C = 1000, 1.0
SVM_COMPONENTS, SVM_ITERATIONS, SVM_TOLERANCE = 100, 50, 1e-3
FOLDS = 5

MAX_CLASSES = 1000  # classes a target may have
FIT_PARTITIONS = 8  # tasks per fitting step, at least
FIT_NUMBERS = 1 << 23  # numbers that a fit keeps for the rows of one task; larger tables get more tasks

ALGORITHMS = (
    ("decision_tree", "Decision Tree", "one tree of threshold tests", "classes with clear decision rules"),
    ("random_forest", "Random Forest", "vote of many randomised trees", "high accuracy on tabular data"),
    ("logistic_regression", "Logistic Regression", "linear model of class odds", "linear relations and probabilities"),
    ("svm", "Support Vector Machine", "maximum-margin separation", "many features and curved boundaries"),
)


def algorithms(spark: SparkSession) -> DataFrame:
    """The classifiers that can be trained."""
    return _rows(spark, list(ALGORITHMS), "algorithm string, name string, description string, best_for string")


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Random cosine features whose inner products approximate a Gaussian kernel.

    Weights are drawn again from the seed wherever they are needed, so the stage
    is saved as its few parameters.
    """

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    components = Param(Params._dummy(), "components", "number of features", TypeConverters.toInt)
    dimensions = Param(Params._dummy(), "dimensions", "number of inputs", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, gamma=1.0, components=SVM_COMPONENTS, dimensions=1, seed=SEED):
        super().__init__()
        self._setDefault(gamma=1.0, components=SVM_COMPONENTS, dimensions=1, seed=SEED)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        gamma, size = self.getOrDefault(self.gamma), self.getOrDefault(self.components)
        width, seed = self.getOrDefault(self.dimensions), self.getOrDefault(self.seed)

        @F.pandas_udf("array<double>")
        def mapped(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=object)
            return pd.Series(list(cosines(np.stack(rows.to_numpy()), *cosine_weights(gamma, width, size, seed))))

        made = mapped(vector_to_array(F.col(self.getInputCol())))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(made))


class KernelMachines(FourierFeatures):
    """Linear one-against-rest machines on cosine features, which never leave the function that makes them.

    Adds the margins of all classes and the code of the greatest.
    """

    slopes = Param(Params._dummy(), "slopes", "weights of the cosine features, one class after another", TypeConverters.toListFloat)
    shifts = Param(Params._dummy(), "shifts", "intercept per class", TypeConverters.toListFloat)

    @keyword_only
    def __init__(
        self, *, inputCol=None, gamma=1.0, components=SVM_COMPONENTS, dimensions=1, seed=SEED, slopes=None, shifts=None
    ):
        kwargs = self._input_kwargs
        super().__init__()
        self._set(**{k: v for k, v in kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        gamma, size = self.getOrDefault(self.gamma), self.getOrDefault(self.components)
        width, seed = self.getOrDefault(self.dimensions), self.getOrDefault(self.seed)
        shifts = np.array(self.getOrDefault(self.shifts))
        slopes = np.array(self.getOrDefault(self.slopes)).reshape(len(shifts), size)

        @F.pandas_udf("array<double>")
        def scores(rows: pd.Series) -> pd.Series:
            weights, shift = cosine_weights(gamma, width, size, seed)
            found = []
            for at in range(0, len(rows), CHUNK_ROWS):
                mapped = cosines(np.stack(rows.to_numpy()[at : at + CHUNK_ROWS]), weights, shift)
                found.extend(mapped @ slopes.T + shifts)
            return pd.Series(found, dtype=object)

        made = dataset.withColumn("_margins", scores(vector_to_array(F.col(self.getInputCol()))))
        greatest = F.array_position("_margins", F.array_max("_margins")) - 1
        made = made.withColumn("rawPrediction", array_to_vector(F.col("_margins")))
        return made.withColumn("prediction", greatest.cast("double")).drop("_margins")


class MarginCalibrator(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Turns one-against-rest margins into class probabilities by fitted sigmoids."""

    slopes = Param(Params._dummy(), "slopes", "sigmoid slope per class", TypeConverters.toListFloat)
    shifts = Param(Params._dummy(), "shifts", "sigmoid shift per class", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, slopes=None, shifts=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        margins = vector_to_array(F.col("rawPrediction"))
        pairs = list(zip(self.getOrDefault(self.slopes), self.getOrDefault(self.shifts)))
        single = [F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * margins[k] + F.lit(b)))) for k, (a, b) in enumerate(pairs)]
        odds = dataset.withColumn("_odds", F.array(*single))
        total = F.aggregate("_odds", F.lit(0.0), lambda s, x: s + x)
        return odds.withColumn("probability", array_to_vector(F.transform("_odds", lambda x: x / total))).drop("_odds")


def _width(df: DataFrame) -> int:
    """The number of features of a vector."""
    one = df.select(vector_to_array(F.col("features")).alias("row")).first()
    return len(one["row"]) if one else 0


def _fit_sigmoids(scored: DataFrame, label: str, codes: Sequence[int]) -> tuple[list[float], list[float]]:
    """Slope and shift that turn each margin of ``m`` into the chance of its class."""
    slopes, shifts = [], []
    for i, k in enumerate(codes):
        one = scored.select((F.col(label) == k).cast("double").alias("y"), array_to_vector(F.array(F.col("m")[i])).alias("x"))
        sigmoid = LogisticRegression(featuresCol="x", labelCol="y", maxIter=100).fit(one)
        slopes.append(float(sigmoid.coefficients[0]))
        shifts.append(float(sigmoid.intercept))
    return slopes, shifts


def _fit_kernel_svm(train: DataFrame, rows: int, seed: int) -> PipelineModel:
    """Machines on cosine features; the rows are kept as they are, and their cosine features are made in each pass."""
    width, cells = _width(train), vector_to_array(F.col("features"))
    variance = train.select(F.explode(cells).alias("cell")).agg(F.var_pop("cell")).first()[0] or 1.0
    options = {"inputCol": "features", "gamma": 1.0 / (width * variance), "dimensions": width, "seed": seed}
    weights, shift = cosine_weights(options["gamma"], width, SVM_COMPONENTS, seed)
    codes = range(int(train.agg(F.max("label_code")).first()[0]) + 1)
    data = margins.pack(train.select(F.col("label_code").cast("int").alias("label"), cells.alias("cells")), width).persist()
    slopes, intercepts = margins.fit_machines(
        data, codes, weights, shift, 1.0 / max(1, rows), SVM_ITERATIONS, SVM_TOLERANCE
    )
    sigmoids: tuple[list[float], list[float]] = ([], [])
    for at in range(0, len(codes), margins.AT_ONCE):  # margins of no more classes are kept at once
        few = slice(at, at + margins.AT_ONCE)
        some = margins.margins(data, weights, shift, slopes[few], intercepts[few]).persist()
        for all_of, new in zip(sigmoids, _fit_sigmoids(some, "label", codes[few])):
            all_of.extend(new)
        some.unpersist()
    data.unpersist()
    model = KernelMachines(slopes=slopes.ravel().tolist(), shifts=intercepts.tolist(), **options)
    return PipelineModel([model, MarginCalibrator(slopes=sigmoids[0], shifts=sigmoids[1])])


def _fit_svm(train: DataFrame, rows: int, kernel: str, seed: int) -> PipelineModel:
    """Linear one-against-rest machines, on cosine features or as they are, with calibrated probabilities."""
    if kernel == "rbf":
        return _fit_kernel_svm(train, rows, seed)
    train = train.select("label_code", "features").persist()
    machine = LinearSVC(
        featuresCol="features",
        labelCol="label_code",
        maxIter=SVM_ITERATIONS,
        tol=SVM_TOLERANCE,
        regParam=1.0 / max(1, rows),
        standardization=False,
    )
    rest = OneVsRest(
        classifier=machine, featuresCol="features", labelCol="label_code", rawPredictionCol="rawPrediction", parallelism=4
    )
    model = rest.fit(train)
    scored = model.transform(train).select("label_code", vector_to_array(F.col("rawPrediction")).alias("m")).persist()
    slopes, shifts = _fit_sigmoids(scored, "label_code", range(len(model.models)))
    scored.unpersist()
    train.unpersist()
    return PipelineModel([model, MarginCalibrator(slopes=slopes, shifts=shifts)])


def make_classifier(algorithm: str, rows: int, depth: int = TREE_DEPTH, seed: int = SEED):
    """Unfitted estimator of an algorithm; ``rows`` sets the logistic penalty."""
    common = {"featuresCol": "features", "labelCol": "label_code"}
    if algorithm == "decision_tree":
        return DecisionTreeClassifier(**common, maxDepth=depth, minInstancesPerNode=MIN_LEAF, maxBins=128, seed=seed)
    if algorithm == "random_forest":
        return RandomForestClassifier(
            **common, numTrees=FOREST_TREES, maxDepth=depth, maxBins=128, maxMemoryInMB=1024, seed=seed
        )
    if algorithm == "logistic_regression":
        penalty = 1.0 / (LOGISTIC_C * max(1, rows))
        return LogisticRegression(
            **common, maxIter=LOGISTIC_ITERATIONS, regParam=penalty, standardization=False, family="multinomial"
        )
    raise ValueError(f"unknown algorithm {algorithm!r}")


def fit_classifier(
    train: DataFrame, algorithm: str, rows: int, depth: int = TREE_DEPTH, kernel: str = "rbf", seed: int = SEED
) -> Model:
    """Fit on columns ``features`` and ``label_code``."""
    if algorithm == "svm":
        return _fit_svm(train, rows, kernel, seed)
    return make_classifier(algorithm, rows, depth, seed).fit(train)


def index_target(df: DataFrame, target: str, max_classes: int = MAX_CLASSES) -> StringIndexer:
    """Fitted encoder of the class label, codes in value order.

    Labels come to the driver, so a target with more than ``max_classes`` of them is an error; no row is dropped.
    """
    classes = df.select(as_column(target)).distinct().limit(max_classes + 1).count()
    if classes > max_classes:
        raise ValueError(f"{target!r} has more than {max_classes} classes; it is not a class label, or max_classes must be raised")
    # all labels are present at fitting time; "keep" would make room for one class more
    return StringIndexer(inputCol=target, outputCol="label_code", stringOrderType="alphabetAsc").fit(df)


def apply_model(model: Model | PipelineModel, df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Add ``prediction`` (class name), ``probabilities`` and ``confidence`` to every row."""
    scored = model.transform(df)
    probabilities = vector_to_array(F.col("probability"))
    named = F.element_at(F.array(*[F.lit(v) for v in labels]), (F.col("prediction") + 1).cast("int"))
    keep = [as_column(c) for c in df.columns if c not in ("prediction", "probability", "rawPrediction")]
    return scored.select(
        *keep,
        named.alias("prediction"),
        probabilities.alias("probabilities"),
    ).withColumn("confidence", F.array_max("probabilities"))


def fit_partitions(rows: int, width: int, least: int = FIT_PARTITIONS) -> int:
    """How many tasks fit a table of ``rows`` rows of ``width`` features; grows with the table from ``least`` on.

    Besides its features, a row is kept with its cosine features, or with how often each tree draws it.
    """
    return max(least, math.ceil(rows * (width + max(SVM_COMPONENTS, FOREST_TREES)) / FIT_NUMBERS))


def fit_layout(df: DataFrame, key: str, partitions: int = FIT_PARTITIONS) -> DataFrame:
    """Rows dealt by the hash of their key and ordered in each partition.

    Bootstrap samples are seeded per partition, so a fitted forest depends on the layout; this one depends on nothing
    but the keys and ``partitions``.
    """
    return df.repartition(partitions, as_column(key)).sortWithinPartitions(as_column(key))


def cross_validate(
    df: DataFrame,
    algorithm: str,
    key: str,
    rows: int,
    folds: int = FOLDS,
    kernel: str = "rbf",
    seed: int = SEED,
    partitions: int = FIT_PARTITIONS,
) -> DataFrame:
    """Mean and population deviation of accuracy over stratified folds; large tables get more tasks than ``partitions``."""
    folds = max(2, min(folds, rows // 2))
    data = fold_numbers(df.select(as_column(key).alias("_key"), "features", "label_code"), "label_code", ["_key"], folds, seed)
    partitions = fit_partitions(rows, _width(df), partitions)
    data = fit_layout(data, "_key", partitions).select("features", "label_code", "fold").persist()
    fitted_rows = rows - rows // folds  # the penalty of a fold's model is that of the rows it sees
    scorer = MulticlassClassificationEvaluator(labelCol="label_code", predictionCol="prediction", metricName="accuracy")
    if algorithm == "svm":
        values = []
        for k in range(folds):
            model = fit_classifier(data.where(F.col("fold") != k), algorithm, fitted_rows, kernel=kernel, seed=seed)
            values.append(scorer.evaluate(model.transform(data.where(F.col("fold") == k))))
        mean, std = float(np.mean(values)), float(np.std(values))
    else:
        search = CrossValidator(
            estimator=make_classifier(algorithm, fitted_rows, seed=seed),
            estimatorParamMaps=ParamGridBuilder().build(),
            evaluator=scorer,
            numFolds=folds,
            foldCol="fold",
        ).fit(data)
        mean, std = float(search.avgMetrics[0]), float(search.stdMetrics[0])
    data.unpersist()
    return _rows(df.sparkSession, [(folds, mean, std)], "folds int, cv_mean double, cv_std double")


def feature_importance(spark: SparkSession, model: Model | PipelineModel, features: Sequence[str]) -> DataFrame:
    """Importance per feature: impurity-based for trees, absolute weight for linear models, null where there is none."""
    if isinstance(model, PipelineModel):
        model = next((s for s in model.stages if hasattr(s, "models")), None)
    if model is None:  # weights of cosine features name no input
        values = [None] * len(features)
    elif hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix"):
        values = np.abs(model.coefficientMatrix.toArray()[0])
    else:
        values = np.abs(model.models[0].coefficients.toArray())
        if len(values) != len(features):
            values = [None] * len(features)
    return _rows(
        spark, [(f, None if v is None else float(v)) for f, v in zip(features, values)], "feature string, importance double"
    )


def tree_rules(spark: SparkSession, model: Model, features: Sequence[str], depth: int = RULE_DEPTH) -> DataFrame:
    """Text of a tree's tests down to a depth, one line per row, with feature names."""
    lines = []
    for line in model.toDebugString.splitlines()[1:]:
        level = len(line) - len(line.lstrip()) - 2
        if line.strip() and level <= depth:
            text = re.sub(r"feature (\d+)", lambda m: features[int(m.group(1))], line.strip())
            lines.append((len(lines), level, text))
    return _rows(spark, lines, "line int, depth int, rule string")


_TEST = re.compile(r"(?:If|Else) \((.*) (<=|>) (\S+)\)$")


def apply_rules(df: DataFrame, rules: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Add ``rule_prediction``: the class that the lines of :func:`tree_rules` give each row.

    Tests read the columns they name, as they are; a row with a missing value in a test fails it. The lines must hold
    the whole tree. They are read back into one expression, so printed rules can be checked against their model.
    """
    lines = [(r["depth"], r["rule"]) for r in rules.orderBy("line").collect()]  # two to the power of the depth
    at = 0

    def read() -> Column:
        nonlocal at
        depth, text = lines[at]
        at += 1
        if text.startswith("Predict: "):
            return F.lit(classes[int(float(text.removeprefix("Predict: ")))])
        test = _TEST.match(text)
        if test is None:
            raise ValueError(f"not a rule: {text}")
        value, edge = as_column(test[1]).cast("double"), F.lit(float(test[3]))
        met = value <= edge if test[2] == "<=" else value > edge
        inner = read()
        if at >= len(lines) or not lines[at][1].startswith("Else") or lines[at][0] != depth:
            raise ValueError(f"rules end inside a test: {text}")
        at += 1
        return F.when(met, inner).otherwise(read())

    return df.withColumn("rule_prediction", read())
