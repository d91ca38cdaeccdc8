"""Importance resampling towards a target: hashed word and word-pair counts, log-ratio weights, Gumbel top-k draw.

The bucket of a feature is its CRC-32. A CRC is an exclusive-or of one contribution per byte, which depends only on the
byte and its distance from the end, and a constant for the length. So the CRCs of all features of many texts come from
one look-up per byte in a table (byte by distance from the end) and one ``bitwise_xor.reduceat`` over the spans. Spans
longer than the table are folded block by block: the register so far moves on by a block of zero bytes, another table,
and takes the next block's value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.common import table, written
from tablewright.llm.words import LOWER, byte_slices, word_spans

BUCKETS = 10_000
PERCENT, LEAST_WORDS, SEED = 25, 20, 7
REACH = 64  # bytes before the end that the table covers

#: Bytes of words, after lower-casing: digits, a-z and everything beyond ASCII.
OF_WORD = np.zeros(256, bool)
OF_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _step_table() -> np.ndarray:
    """The register after one byte, for the reflected polynomial of CRC-32."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> np.uint32(1)) ^ np.uint32(0xEDB88320), out >> np.uint32(1))
    return out


_STEP = _step_table()


def _zeros(register: np.ndarray, n: int = 1) -> np.ndarray:
    """Registers after ``n`` zero bytes."""
    for _ in range(n):
        register = _STEP[register & np.uint32(255)] ^ (register >> np.uint32(8))
    return register


#: Contribution of a byte, by distance from the end; the register that starts with ones, by length.
_AT = np.empty((REACH, 256), np.uint32)
_AT[0] = _STEP
for _d in range(1, REACH):
    _AT[_d] = _zeros(_AT[_d - 1])
_FLAT = _AT.ravel()
_START = np.full(REACH + 1, 0xFFFFFFFF, np.uint32)
for _d in range(1, REACH + 1):
    _START[_d] = _zeros(_START[_d - 1])
#: A register after ``REACH`` zero bytes, as the exclusive-or of one entry for each of its four bytes.
_MOVE = np.stack([_zeros(np.arange(256, dtype=np.uint32) << np.uint32(8 * i), REACH) for i in range(4)])


def _xor(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Contributions of spans of 1 to ``REACH`` bytes."""
    upto = np.cumsum(size)
    before = upto - size
    far = np.repeat(upto, size) - np.arange(upto[-1] if len(upto) else 0) - 1
    byte = data[np.arange(len(far)) + np.repeat(start - before, size)]
    return np.bitwise_xor.reduceat(_FLAT[far * 256 + byte], before) if len(far) else np.empty(0, np.uint32)


def crc32_of_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of the bytes; spans may overlap and must not be empty."""
    size = end - start
    head = (size - 1) % REACH + 1  # the first block is the odd one
    register = _START[head] ^ _xor(data, start, head)
    at = start + head
    left = np.flatnonzero(at < end)
    while len(left):
        r = register[left]
        moved = _MOVE[0][r & 255] ^ _MOVE[1][(r >> 8) & 255] ^ _MOVE[2][(r >> 16) & 255] ^ _MOVE[3][r >> 24]
        register[left] = moved ^ _xor(data, at[left], np.full(len(left), REACH))
        at[left] += REACH
        left = left[at[left] < end[left]]
    return register ^ np.uint32(0xFFFFFFFF)


def feature_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bucket, row)`` of every single word and pair of neighbouring words, and the words of each row."""
    data = LOWER[data]
    start, end, row = word_spans(data, offsets, OF_WORD)
    # the words again, joined by one space
    size = end - start
    stop = np.cumsum(size + 1)
    joined = np.full(int(stop[-1]) if len(stop) else 0, 32, np.uint8)
    first = stop - size - 1
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    joined[place + np.repeat(first, size)] = data[place + np.repeat(start, size)]
    last = stop - 1
    pair = np.flatnonzero(row[1:] == row[:-1])
    crc = crc32_of_spans(joined, np.concatenate([first, first[pair]]), np.concatenate([last, last[pair + 1]]))
    return (crc % np.uint32(buckets)).astype(np.int64), np.concatenate([row, row[pair]]), np.bincount(row, minlength=len(offsets) - 1)


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)``: features of all texts by bucket. Every task sums its own before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in byte_slices(batch.column(0)):
                total += np.bincount(feature_buckets(data, offsets, buckets)[0], minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], ["bucket", "n"])

    return texts.select(F.col(f"`{text}`")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, from ``(bucket, n)`` of both sides: thousandths of the log ratio of smoothed shares.

    The driver holds one number per bucket.
    """
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, of in ((s, source), (t, target)):
        for r in of.collect():  # a row per bucket at most
            counts[r["bucket"]] = r["n"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(documents: DataFrame, gains: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_words, n_features, weight)``: the floored mean gain of a row's features, 0 without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in byte_slices(batch.column(1)):
                rows = len(offsets) - 1
                bucket, row, words = feature_buckets(data, offsets, len(gains))
                n = np.bincount(row, minlength=rows)
                total = np.bincount(row, gains[bucket], rows).astype(np.int64)  # sums of small integers: exact
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), *(pa.array(c, pa.int64()) for c in (words, n, weight))], ["key", "n_words", "n_features", "weight"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, f"key {kind}, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate that depends on the seed and the key alone; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    documents: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS
) -> DataFrame:
    """``(key, n_features, weight, score, rank)`` of every row; ``rank`` is null where a row is not drawn.

    Of the rows with ``least_words`` words or more, ``percent`` of a hundred (rounded down) with the highest scores are
    drawn, ties to the smaller key, null keys last. Null texts have no words. Rows that share a key are drawn one by one,
    in an order that their weights and places in the table decide. Other columns are ignored; an empty table gives no
    rows; an empty target leaves weights that only favour rare buckets.
    """
    gains = bucket_gains(bucket_counts(documents, text, buckets), bucket_counts(target, text, buckets), buckets)
    scored = weights(documents, gains, key, text)
    scored = written(scored.select("*", (F.col("weight") + gumbel(F.col("key"), seed)).alias("score"), F.monotonically_increasing_id().alias("row")), "scored")
    asked = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_last("key"), F.asc("row")]
    # ranges of the wanted order; written, as the bounds of ranges are drawn anew on every run
    ranged = written(scored.where(asked).repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("range")  # one row per range
    sizes = sizes.select("range", (F.sum("n").over(upto) - F.col("n")).alias("before"))
    drawn = ranged.count() * percent // 100
    rank = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    ranked = ranged.join(sizes, "range").withColumn("rank", rank)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    rest = scored.where(~asked).withColumn("rank", F.lit(None).cast("long"))
    shown = [F.col("key").alias(key), "n_features", "weight", "score", "rank"]
    return ranked.select(*shown).unionByName(rest.select(*shown))


def op13_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """All documents weighed against all benchmark texts, a quarter of those that are long enough drawn."""
    return resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
