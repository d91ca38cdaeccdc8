"""SimHash near-duplicates through BK-trees.

Each document gets a 64-bit fingerprint. Distinct fingerprints are dealt to shards so that any two within the radius
meet in at least one: with a radius of two, one of three parts of the bits must be equal. A shard's fingerprints form a
BK-tree, children keyed by their distance to the parent, and a search follows only edges within the radius. Shards with
many fingerprints are dealt again by parts of the other bits. Trees stay with their shard: they have no size bound that
would allow a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import numbered, table, written
from tablewright.operators.cluster import connected_components

RADIUS = 2
SHINGLE = 3
SEED = 42


def fingerprint(words: list[str], width: int = SHINGLE) -> int:
    """64-bit SimHash, as a signed integer, of the ``width``-word shingles; 0 without words."""
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        part = words[at : at + 65_536 + width - 1]
        shingles = map(" ".join, zip(*(part[i:] for i in range(width)))) if len(words) >= width else [" ".join(words)]
        h = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            text = pc.ascii_lower(pc.fill_null(part.column(1), ""))
            out = [fingerprint([w for w in words if w]) for words in pc.ascii_split_whitespace(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.int64())], ["key", "fp"])


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, fp)`` of every row; a null text counts as empty."""
    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(_fingerprints, f"key {kind}, fp long")


def _masks(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` runs of the given bit numbers."""
    cut = [len(bits) * i // parts for i in range(parts + 1)]
    return [sum(1 << b for b in bits[cut[i] : cut[i + 1]]) for i in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def within_radius(codes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions of distinct ``codes`` (uint64) that differ in ``radius`` bits or fewer, by a BK-tree of them.

    All searches go down the tree together: at each node the codes still on their way are compared with it at once,
    and those go on to a child whose edge lies within the radius of their own distance.
    """
    todo = [(np.arange(len(codes)), np.arange(len(codes)))]
    while todo:
        nodes, asking = todo.pop()
        root, rest = nodes[0], nodes[1:]
        far = np.bitwise_count(codes[asking] ^ codes[root]).astype(np.int8)
        near = asking[(far <= radius) & (asking > root)]
        if len(near):
            yield np.full(len(near), root), near
        if not len(rest):
            continue
        edge = np.bitwise_count(codes[rest] ^ codes[root])
        for k in np.unique(edge):
            child = rest[edge == k]
            # a pair is found from its smaller position, so only later codes need to look
            on = asking[(np.abs(far - np.int8(k)) <= radius) & (asking > child[0])]
            if len(on):
                todo.append((child, on))


def _roots(codes: np.ndarray, radius: int) -> np.ndarray:
    """For each code the smallest position it is linked to inside the shard."""
    up = np.arange(len(codes))
    for a, b in within_radius(codes, radius):
        for x, y in zip(a.tolist(), b.tolist()):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            while up[y] != y:
                up[y] = up[up[y]]
                y = up[y]
            if x != y:
                up[max(x, y)] = min(x, y)
    for i in range(len(up)):
        up[i] = up[up[i]]
    return up


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; a shard that ends a batch waits for the next."""
        held_shard, held = np.empty((0, 2), np.int64), np.empty(0, np.int64)

        def flush(shard: np.ndarray, fp: np.ndarray, last: bool):
            cuts = np.flatnonzero((shard[1:] != shard[:-1]).any(axis=1)) + 1 if len(fp) else np.empty(0, np.int64)
            start = np.concatenate([[0], cuts])
            stop = np.concatenate([cuts, [len(fp)]])
            keep = 0 if last or not len(fp) else len(fp) - start[-1]
            a, b = [], []
            for i in np.flatnonzero(stop - start > 1):
                if keep and i == len(start) - 1:
                    continue
                codes = fp[start[i] : stop[i]]
                up = _roots(codes.view(np.uint64), radius)
                linked = np.flatnonzero(up != np.arange(len(up)))
                a.append(codes[up[linked]])
                b.append(codes[linked])
            out = [pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in (a, b)]
            return pa.RecordBatch.from_arrays(out, ["a", "b"]), len(fp) - keep

        for batch in batches:
            mask, part, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            shard = np.concatenate([held_shard, np.stack([mask.astype(np.int64), part], axis=1)])
            fp = np.concatenate([held, fp])
            links, done = flush(shard, fp, False)
            held_shard, held = shard[done:], fp[done:]
            yield links
        yield flush(held_shard, held, True)[0]

    return run


def _dealt(codes: DataFrame, radius: int, shard_size: int) -> DataFrame:
    """``(mask, part, fp)``: every fingerprint under each shard it belongs to; crowded shards are dealt once more."""
    parts = radius + 1
    first = _masks(list(range(64)), parts)
    second = {
        i * parts + j: first[i] | m for i in range(parts) for j, m in enumerate(_masks([b for b in range(64) if not first[i] >> b & 1], parts))
    }

    def under(masks: dict[int, int]) -> Column:
        return F.inline(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("part")) for i, m in masks.items()]))

    once = codes.select("fp", under({-1 - i: m for i, m in enumerate(first)}))
    crowded = written(once.groupBy("mask", "part").count().where(F.col("count") > shard_size).select("mask", "part"), "crowded")
    sparse = once.join(crowded, ["mask", "part"], "left_anti").select("mask", "part", "fp")
    if not crowded.limit(1).count():
        return sparse
    again = once.join(crowded, ["mask", "part"], "left_semi").select(F.col("fp"), F.col("mask").alias("under"))
    split = again.select("fp", "under", under(second)).where(F.floor(F.col("mask") / parts) == -1 - F.col("under"))
    return sparse.unionByName(split.select("mask", "part", "fp"))


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, shard_size: int = 50_000) -> DataFrame:
    """``(key, fp, component_id)`` of every row: its fingerprint and the smallest key reachable over links.

    Fingerprints link at ``radius`` or fewer differing bits. Texts are split at ASCII white space after lower-casing
    A-Z; texts without words have fingerprint zero and link like any other. Rows with equal keys stay separate rows. A
    null key never names a component; a component of null keys alone has a null id. Other columns are ignored; an empty
    table gives no rows. ``shard_size`` bounds the fingerprints that a task compares at a time; it drops nothing.
    """
    marked = written(fingerprints(documents, key, text), "fingerprints")
    codes = written(marked.groupBy("fp").agg(F.min("key").alias("least")), "codes")
    shards = _dealt(codes.select("fp"), radius, shard_size)
    shards = shards.repartition("mask", "part").sortWithinPartitions("mask", "part", "fp")
    links = shards.mapInArrow(_links(radius), "a long, b long").where("a != b").distinct()
    member = connected_components(written(links, "links"))  # (node, root) of linked fingerprints
    rooted = codes.join(member, codes.fp == member.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_code = written(rooted.join(named, "root").select("fp", "component_id"), "components")
    return marked.join(of_code, "fp").select(F.col("key").alias(key), "fp", "component_id")


def keep_one_of_each(documents: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The documents, all columns, with one row of each component of :func:`near_duplicates`.

    Rows are judged by a number of their own, whatever keys they share or lack, so repeated rows go too. The row with
    the smallest key stays; a null key comes last. All texts without words are copies of each other.
    """
    rows, row = numbered(documents)
    found = near_duplicates(rows, row, text, radius).select(F.col(row).alias("row"), F.col("component_id").alias("root"))
    named = rows.select(F.col(row).alias("row"), F.col(f"`{key}`").alias("key")).join(found, "row")
    kept = named.groupBy("root").agg(F.min(F.struct(F.isnull("key").alias("last"), "key", "row"))["row"].alias("kept"))
    return rows.join(kept.select(F.col("kept").alias(row)), row, "left_semi").drop(row)


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with fingerprint and component."""
    out = near_duplicates(table(spark, folder, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
