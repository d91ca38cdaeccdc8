"""Toxicity classifier with counterfactual regularisation.

A logistic model over words and word beginnings is fitted on a bounded sample of labelled texts. Where a labelled text
names a group of people, the term is swapped for others of its kind; the squared change of the score is penalised, so a
mention as such cannot move a score, while the words around it can.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tablewright.llm.common import crc_of_id, free_name, table, written

THRESHOLD = 0.3
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000  # bounds of the fitted sample; scoring covers every row
FEATURES = 20_000
STEMS = (5, 7)  # lengths of word beginnings
FULL = 50.0  # a word counts fully from one place in so many on
_WORD = re.compile(r"\w+")
CACHED_WORDS = 500_000

#: Terms that may stand for each other, by kind; a parameter of :func:`fit`.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "sikhs"),
    ("black", "white", "asian", "african", "european", "latino", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("woman", "man"),
    ("women", "men"),
    ("female", "male"),
    ("immigrant", "native", "refugee", "foreigner"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("disabled", "deaf", "blind", "autistic"),
    ("old", "young", "elderly", "teenage"),
)


def _features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


def _weights_of_words(text: str | None) -> dict[str, float]:
    """Each distinct word with the weight its share of the text gives it."""
    words = _WORD.findall((text or "").lower())
    scale = FULL / max(1, len(words))
    return {w: min(1.0, c * scale) for w, c in Counter(words).items()}


def _vector(words: dict[str, float], index: dict[str, int]) -> dict[int, float]:
    out: dict[int, float] = {}
    for word, value in words.items():
        for f in _features(word):
            if (i := index.get(f)) is not None:
                out[i] = out.get(i, 0.0) + value
    return out


def _swapped(words: dict[str, float], kinds, turn: int) -> dict[str, float] | None:
    """The words with every identity term replaced by the one ``turn`` places on in its kind; None if there are none."""
    out, found = dict(words), False
    for terms in kinds:
        here = [t for t in terms if t in words]
        found |= bool(here)
        for t in here:
            out.pop(t, None)
        for t in here:
            other = terms[(terms.index(t) + turn) % len(terms)]
            out[other] = min(1.0, out.get(other, 0.0) + words[t])
    return out if found else None


class Rows:
    """Sparse rows with products both ways."""

    def __init__(self, rows: list[dict[int, float]], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows]) if rows else np.empty(0, np.int64)
        self.column = np.fromiter((i for r in rows for i in r), np.int64, len(self.row))
        self.value = np.fromiter((v for r in rows for v in r.values()), np.float64, len(self.row))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * w[self.column], minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=self.value * r[self.row], minlength=self.width)


def fit_weights(x: Rows, y: np.ndarray, weight: np.ndarray, swaps: Rows, ridge: float, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise weighted log loss + ridge + penalty times the mean squared change under swaps."""
    w, b = np.zeros(x.width), 0.0
    m, v = np.zeros(x.width + 1), np.zeros(x.width + 1)
    total = max(weight.sum(), 1e-9)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w) + b, -30, 30)))
        error = weight * (p - y) / total
        g = x.back(error) + ridge * w
        if swaps.n:
            g += 2 * penalty / swaps.n * swaps.back(swaps.dot(w))
        g = np.append(g, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


class Model:
    """Feature weights and intercept; a few hundred kilobytes, bounded by ``FEATURES``."""

    def __init__(self, weights: dict[str, float], intercept: float):
        self.weights, self.intercept = weights, intercept

    def score_all(self, texts: list[str | None], cache: dict[str, float]) -> list[float]:
        out, weights = [], self.weights
        for text in texts:
            z = self.intercept
            words = _WORD.findall((text or "").lower())
            scale = FULL / max(1, len(words))
            for w, c in Counter(words).items():
                known = cache.get(w)
                if known is None:
                    known = cache[w] = sum(weights.get(f, 0.0) for f in _features(w))
                if known:
                    z += min(1.0, c * scale) * known
            out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        return out


def labelled_sample(documents: DataFrame, labels: DataFrame, allowed, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> DataFrame:
    """``(text, toxic)`` of at most so many labelled rows of each class, chosen by the hash of their id.

    Labels that contradict each other count as toxic. ``allowed`` is a condition on ``doc_id``.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(allowed)
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = known.where("toxic = 1").orderBy(*order).limit(toxic).unionByName(known.where("toxic = 0").orderBy(*order).limit(clean))
    # at most toxic + clean pairs of numbers
    texts = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    # ids may repeat: one text for each
    return texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[toxic].update({f for w in set(_WORD.findall((text or "").lower())) for f in _features(w)})
        names = list(counts[0].keys() | counts[1].keys())
        columns = [pa.array([c[f] for f in names], pa.int64()) for c in counts]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *columns], ["feature", "clean", "toxic"])


def fit(sample: DataFrame, kinds=IDENTITY_TERMS, features: int = FEATURES, ridge: float = 1e-5, penalty: float = 1.0, swaps: int = 2) -> Model:
    """Fit on ``(text, toxic)``; the sample must be bounded.

    The ``features`` words and word beginnings are chosen whose frequencies differ most between the classes. Without
    rows of both classes the model says 0 for everything.
    """
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return Model({}, -30.0)
    counted = sample.select("text", "toxic").mapInArrow(_counted, "feature string, clean long, toxic long")
    counted = counted.groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).where("c + t >= 3")
    expected = (F.col("c") + F.col("t")) * (n1 / (n0 + n1))
    strength = F.pow(F.col("t") - expected, 2) / expected
    chosen = [r["feature"] for r in counted.orderBy(F.desc(strength), "feature").select("feature").limit(features).collect()]
    index = {f: i for i, f in enumerate(chosen)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _weights_of_words(text)
                x = _vector(words, index)
                rows = [(toxic, x)]
                for turn in range(1, swaps + 1):
                    other = _swapped(words, kinds, turn)
                    if other is not None:
                        y = _vector(other, index)
                        change = {i: y.get(i, 0.0) - x.get(i, 0.0) for i in x.keys() | y.keys()}
                        rows.append((2, {i: d for i, d in change.items() if d}))
                for kind, row in rows:
                    out[0].append(kind), out[1].append(list(row)), out[2].append(list(row.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int32()), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.list_(pa.float32()))], ["kind", "at", "value"]
            )

    rows = sample.select("text", "toxic").mapInArrow(vectors, "kind int, at array<int>, value array<float>").collect()
    rows.sort(key=lambda r: (r["kind"], r["at"], r["value"]))  # the same sums whatever the order of tasks
    x = Rows([dict(zip(r["at"], r["value"])) for r in rows if r["kind"] < 2], len(chosen))
    moved = Rows([dict(zip(r["at"], r["value"])) for r in rows if r["kind"] == 2], len(chosen))
    y = np.array([r["kind"] for r in rows if r["kind"] < 2], np.float64)
    w, b = fit_weights(x, y, np.ones(len(y)), moved, ridge, penalty)
    return Model({f: float(v) for f, v in zip(chosen, w) if v}, float(b))


def _scorer(model: Model, column: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                if len(cache) > CACHED_WORDS:
                    cache.clear()
                scores = pa.array(model.score_all(part.column(column).to_pylist(), cache), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, scores], [*part.schema.names, name])

    return run


SCORE = "_toxicity"


def with_score(documents: DataFrame, model: Model, text: str = "text", name: str = SCORE) -> DataFrame:
    """All rows and columns with the score, between 0 and 1, as ``name``; a column that has this name is replaced.

    Null and empty texts get the score of no words.
    """
    rows = documents.drop(name)
    return rows.mapInArrow(_scorer(model, rows.columns.index(text), name), StructType([*rows.schema, StructField(name, DoubleType())]))


def trained(documents: DataFrame, labels: DataFrame) -> Model:
    """The model of the labels whose id's CRC-32 is not 2 modulo 4."""
    return fit(written(labelled_sample(documents, labels, crc_of_id() % 4 != 2), "labelled"))


def drop_toxic(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, whose score stays below the threshold."""
    name = free_name(documents, SCORE)
    return with_score(documents, model, name=name).where(F.col(name) < threshold).drop(name)


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """All documents scored by the model of the labels that may be learnt from.

    Repeated rows and null ids are scored like any other; extra columns are ignored; an empty table gives no rows.
    """
    documents = table(spark, folder, "documents").select("doc_id", "text")
    scored = with_score(documents, trained(documents, table(spark, folder, "labels")))
    return scored.select(
        "doc_id",
        (crc_of_id() % 4 == 2).alias("held_out"),
        F.col(SCORE).alias("score"),
        F.when(F.col(SCORE) >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"),
    )
