"""The training-data pipeline: toxic documents go, one of each near-duplicate group stays, benchmark leaks go, the rest is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import decontaminate, sentencepiece_codec, simhash_dedup, toxicity
from tablewright.llm.common import table, written


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels of these documents.

    Rows are judged by their texts alone: repeated rows and rows without an id or text are judged like any other.
    """
    return toxicity.drop_toxic(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the smallest id: three-word shingles, two bits at most.

    Repeated rows are copies of each other, and so are all texts without words; rows without an id stay only if no copy
    has one.
    """
    return simhash_dedup.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows are judged one by one, whatever ids they share or lack."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document that is left, row by row; a document without text has none."""
    return sentencepiece_codec.encode(docs, sentencepiece_codec.public_model())


STAGES = [
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", encoding),
]

#: No SQL expresses a trained classifier or the encoder; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what a stage keeps is written before the next one reads it.

    All stages but the last return the columns they got, extra ones included. An empty table stays empty. What becomes
    of repeated rows, null ids and null texts is said at each stage.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
