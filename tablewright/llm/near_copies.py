"""Near copies: rows whose texts share four fifths or more of their five-word shingles.

Texts with the same shingles are one node. ``BANDS`` buckets of ``ROWS`` MinHash values each bring together the nodes
that may be near copies: at a Jaccard similarity of exactly 0.8 a pair has no common bucket with probability 1.7e-8, at
higher ones less. Inside a bucket the similarity is computed from the shingles themselves. A crowded bucket is dealt to
blocks, and any two of its blocks meet in one tile, so the nodes and shingles of a task are bounded and no pair is left
out; what leaves a tile are links that span its components, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import numbered, written
from tablewright.operators.cluster import connected_components

SHINGLE = 5
BANDS, ROWS = 45, 5
BLOCK_NODES, BLOCK_SHINGLES = 1_000, 1_000_000
SEED = 42

_draw = np.random.default_rng(SEED)
_FLIP = _draw.integers(0, 2**32, BANDS * ROWS, np.uint32)[:, None]
_TIMES = _draw.integers(0, 2**32, BANDS * ROWS, np.uint32)[:, None] | np.uint32(1)


def shingles(words: list[str], width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; a shorter text is one shingle, an empty one has none."""
    if not words:
        return np.empty(0, np.uint64)
    runs = map(" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in runs), np.uint64))


def buckets(hashes: np.ndarray) -> np.ndarray:
    """``BANDS`` bucket numbers of a set of shingles."""
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    room = np.empty((BANDS * ROWS, 256), np.uint32)
    for at in range(0, len(low), 256):
        part = low[at : at + 256]
        mixed = np.bitwise_xor(part, _FLIP, out=room[:, : len(part)])
        np.minimum(least, np.multiply(mixed, _TIMES, out=mixed).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _words(column: pa.Array) -> Iterator[list[str]]:
    for at in range(0, len(column), 200):
        text = pc.ascii_lower(pc.fill_null(column.slice(at, 200), ""))
        yield from ([w for w in words if w] for words in pc.ascii_split_whitespace(text).to_pylist())


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(words) for words in _words(batch.column(1))]
        columns = [
            batch.column(0),
            pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([buckets(s) if len(s) else np.empty(0, np.int64) for s in sets], pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["row", "digest", "n", "buckets"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = pa.array([shingles(words).tobytes() for words in _words(batch.column(1))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), out], ["node", "hashes"])


def linked(nodes: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of ``nodes`` whose sets have a Jaccard similarity of 0.8 or more."""
    sizes = np.array([len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    many = times[column] > 1  # the others are shared by nobody
    column, owner = column[many], owner[many]
    at = np.searchsorted(owner, np.arange(len(sets) + 1))
    holders = owner[np.argsort(column, kind="stable")]
    times = np.where(times > 1, times, 0)
    start = np.cumsum(times) - times
    label = np.arange(len(sets))
    for i in range(len(sets)):
        mine = column[at[i] : at[i + 1]]
        n = times[mine]
        of = np.repeat(start[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(holders[of], minlength=len(sets))
        # shared / (size + size - shared) >= 4 / 5
        group = np.unique(label[9 * shared >= 4 * (sizes + sizes[i])])
        if len(group) > 1:
            label[np.isin(label, group)] = group[0]
    on = np.flatnonzero(label != np.arange(len(sets)))
    return nodes[label[on]], nodes[on]


def _tile(tile: pa.Table) -> pa.Table:
    sets = [np.frombuffer(x, np.uint64) for x in tile.column("hashes").to_pylist()]
    a, b = linked(tile.column("node").to_numpy(), sets)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def components(rows: DataFrame, block_nodes: int = BLOCK_NODES, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``(row, root)`` of every row of ``(row, text)``: rows linked by near copies, over any number of links, share a root.

    ``row`` must be a distinct long. A null text counts as empty, and all texts without words are copies of each other.
    """
    marks = written(rows.select("row", "text").mapInArrow(_marks, "row long, digest binary, n long, buckets array<long>"), "marks")
    same = written(marks.groupBy("digest").agg(F.min("row").alias("node")), "same-shingles")
    put = marks.join(same.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "n", F.explode("buckets").alias("bucket"))
    full = put.groupBy("bucket").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("shingles"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("members"))
    # buckets with the same members need one look
    met = full.where("nodes > 1").groupBy("nodes", "members", "shingles").agg(F.min("bucket").alias("bucket"))
    blocks = F.ceil(F.greatest(F.col("nodes") / block_nodes, F.col("shingles") / block_shingles)).cast("int")
    met = written(met.select("bucket", blocks.alias("blocks")), "buckets")
    placed = put.join(met, "bucket").select("node", "bucket", "blocks", F.pmod(F.xxhash64("node", F.lit(SEED)), "blocks").cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = placed.select("node", "bucket", "block", other).select("node", "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    placed = written(placed, "placed")
    asked = rows.select(F.col("row").alias("node"), "text").join(placed.select("node").distinct(), "node", "left_semi")
    sets = written(asked.mapInArrow(_sets, "node long, hashes binary"), "shingle-sets")
    links = placed.join(sets, "node").groupBy("bucket", "i", "j").applyInArrow(_tile, "a long, b long").distinct()
    member = connected_components(written(links, "near-links"))
    of_set = written(same.join(member, "node", "left").select("digest", F.coalesce("root", "node").alias("root")), "roots")
    return marks.select("row", "digest").join(of_set, "digest").select("row", "root")


def keep_one_of_each(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, with one row of each group of near copies.

    The row with the smallest key stays; a null key comes last, and of equal keys one row stays.
    """
    rows, row = numbered(documents)
    rooted = components(rows.select(F.col(row).alias("row"), F.col(f"`{text}`").alias("text")))
    rooted = written(rooted, "near-components")
    named = rows.select(F.col(row).alias("row"), F.col(f"`{key}`").alias("key")).join(rooted, "row")
    kept = named.groupBy("root").agg(F.min(F.struct(F.isnull("key").alias("last"), "key", "row"))["row"].alias("kept"))
    return rows.join(kept.select(F.col("kept").alias(row)), row, "left_semi").drop(row)
