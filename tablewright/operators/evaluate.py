"""Scores of labelled predictions: accuracy, confusion, report, agreement, bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.scalars import as_column

# Bands and cut-offs.
TOP_FEATURES = 8
IMPORTANT = 0.1
PERFORMANCE = ((0.8, "High"), (0.6, "Medium"))
CONFIDENCE = ((0.8, "High"), (0.6, "Medium"))


def accuracy(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows and the share predicted right."""
    right = (as_column(label) == as_column(prediction)).cast("double")
    return scored.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(right).alias("accuracy"))


def confusion(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows per pair of true and predicted class."""
    return scored.groupBy(as_column(label).alias("label"), as_column(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_report(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then macro and weighted means.

    A measure without cases is zero.
    """
    cells = confusion(scored, label, prediction)
    # each cell counts once for its true class and once for its predicted class
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("right")),
                F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("right")),
            )
        )
    )
    zero = F.lit(0.0)
    per_class = sides.groupBy("class").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("right").alias("right"))
    per_class = per_class.withColumn("precision", F.coalesce(F.try_divide("right", "predicted"), zero))
    per_class = per_class.withColumn("recall", F.coalesce(F.try_divide("right", "support"), zero))
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    per_class = per_class.withColumn("f1", F.coalesce(f1, zero))
    measures = ("precision", "recall", "f1")
    listed = per_class.select("class", *measures, "support")
    macro = per_class.agg(*[F.avg(m).alias(m) for m in measures], F.sum("support").alias("support"))
    weighted = per_class.agg(
        *[F.coalesce(F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")), zero).alias(m) for m in measures],
        F.sum("support").alias("support"),
    )
    return listed.unionByName(macro.withColumn("class", F.lit("macro avg"))).unionByName(
        weighted.withColumn("class", F.lit("weighted avg"))
    )


def performance_band(value: str | Column) -> Column:
    """High above 0.8, Medium above 0.6, else Low."""
    value = as_column(value)
    (high, high_label), (medium, medium_label) = PERFORMANCE
    return F.when(value > high, high_label).when(value > medium, medium_label).otherwise("Low")


def confidence_band(value: str | Column) -> Column:
    """High from 0.8, Medium from 0.6, else Low."""
    value = as_column(value)
    (high, high_label), (medium, medium_label) = CONFIDENCE
    return F.when(value >= high, high_label).when(value >= medium, medium_label).otherwise("Low")


def top_features(importance: DataFrame, k: int = TOP_FEATURES) -> DataFrame:
    """The most important features, with how many of all features matter."""
    important = importance.agg(F.count_if(F.col("importance") > IMPORTANT).alias("n_important"))
    top = importance.orderBy(F.col("importance").desc(), "feature").limit(k)
    # the right side is a single row
    return top.crossJoin(important)


def class_distribution(scored: DataFrame, prediction: str = "prediction", confidence: str = "confidence") -> DataFrame:
    """Rows, share and mean confidence per predicted class."""
    groups = scored.groupBy(as_column(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(as_column(confidence)).alias("mean_confidence")
    )
    total = groups.agg(F.sum("n").alias("_total"))
    # the right side is a single row
    return groups.crossJoin(total).select("prediction", "n", (F.col("n") / F.col("_total")).alias("share"), "mean_confidence")


def agreement(scored: dict[str, DataFrame], key: str, prediction: str = "prediction", confidence: str = "confidence") -> DataFrame:
    """For each row, the class most models agree on, how many do, and their mean confidence."""
    tagged = [
        df.select(as_column(key).alias("key"), as_column(prediction).alias("prediction"), as_column(confidence).alias("confidence"))
        for df in scored.values()
    ]
    votes = reduce(DataFrame.unionByName, tagged)
    # a group holds one row per class, at most as many as there are models
    per_class = votes.groupBy("key", "prediction").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("confidence"))
    return per_class.groupBy("key").agg(
        F.min_by("prediction", F.struct(-F.col("n"), F.col("prediction"))).alias("agreed"),
        (F.max("n") * 100 / F.lit(len(tagged))).alias("pct_agreement"),
        (F.sum("confidence") / F.sum("n")).alias("mean_confidence"),
    )


def suggest_targets(roles: DataFrame, features: list[str]) -> DataFrame:
    """Columns that could be a class label; those not used as features come first."""
    name = F.lower("column")
    hinted = name.rlike("id|tag|class|category|type")
    spread = (F.col("role") == "numeric") & (F.col("n_distinct") > 10) & (F.col("n_distinct") < 0.8 * F.col("n_rows"))
    used = F.col("column").isin(*features) if features else F.lit(False)
    found = roles.where((F.col("role") == "categorical") | hinted | spread)
    # one row per column of the table
    return found.select("column", "role", "n_distinct", used.alias("is_feature"), "position").orderBy("is_feature", "position")
