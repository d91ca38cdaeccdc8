"""N-gram Jaccard join by PartEnum signatures.

A text's set holds the hashes of its distinct five-word shingles. Two sets link when their Jaccard similarity is 0.8 or
more, which means that they differ in at most a ninth of the sum of their sizes. Signatures find all such pairs:

* The size band of a set decides into how many cells the domain of the hashes is cut. Sets just below the next band
  take part in both, so that any two similar sets have a band in common.
* If two sets differ in at most a ninth of their sizes, then so they do in some cell that is not empty, because
  otherwise the sums over all cells would not. In that cell their parts, of sizes a and b, differ in at most
  (a + b) / 9 hashes. A part of size a thus takes part at each level ``k = (a + b) // 9`` that a similar part allows.
* At level k a part is dealt to k + 2 partitions. Two parts that differ in at most k hashes have two partitions alike.
  Every pair of partitions is enumerated, and what it holds, together with band, cell and level, is one signature. A
  pair of empty partitions would be alike by chance, so it is replaced by a finer look: the part dealt anew.

Texts with the same set are one node. Signatures travel in large binary rows, and only those that occur on two nodes or
more come back. In each group of a signature all nodes are compared with its leader, the node that meets most others, by
their whole sets. What these links leave apart is compared in tiles of bounded size, where bucket counts, which bound the
difference from below, rule out pairs. Nodes that the other pairs connect form a group, and groups around the same
component become one where that is less. A group gets the whole sets of its nodes and gives no more links than connect its
components, so that nothing is written for each pair. No link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import table, written
from tablewright.llm.words import LOWER, NOT_SPACE, byte_slices, word_spans
from tablewright.operators.cluster import connected_components

WIDTH = 5
SMALLEST_CELL = 3  # hashes in a cell, on average, at the lower end of a band; twice as many at its upper end
REDRAWS = 6
SHARD_SIGNATURES = 1_000_000
HELD = 500_000  # signatures that a task sorts at a time
CROWD = 64  # nodes with one signature among those from which the signature counts as crowded
MIN_BUCKET_BITS = 6  # of hashes that number the buckets in which they are counted, at least
MOST_COUNTED = 15  # in a bucket; two counts are a byte
NUMBERS = 1 << 22  # bucket counts subtracted, or places of hashes multiplied, at a time
BATCH = 8 << 20  # bytes of a batch that a Python function gets
BLOCK = 500  # nodes of a side of a tile
GROUP_HASHES = 1 << 21  # of the sets that are compared together
BROADCAST_ROWS = 1_000_000  # of one long each

TILE, GROUP = ["signature", "i", "j"], ["merged", "group", "i", "j"]

_ODD, _LOW = np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << 48) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _times(n: int) -> np.uint64:
    """A multiple of ``_ODD``, modulo 2 ** 64."""
    return np.uint64(n * int(_ODD) & (1 << 64) - 1)


_LETTER = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BASE, _BACK = np.uint64(0xD1342543DE82EF95), np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, row)``, sorted by row and hash, of the distinct shingles of each row; fewer words make one shingle of all."""
    data, rows = LOWER[data], len(offsets) - 1
    start, end, row = word_spans(data, offsets, NOT_SPACE)
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    # a word's hash: sum of letter times power of the place, from running sums, moved back to place 0
    running = np.concatenate([[np.uint64(0)], np.cumsum(_LETTER[data] * _powers(_BASE, len(data)))])
    word = _mix((running[end] - running[start]) * _powers(_BACK, len(data))[start] + (end - start).astype(np.uint64) * _ODD)
    words = np.bincount(row, minlength=rows)
    first = np.cumsum(words) - words
    factor = _powers(_ODD, width)
    whole = np.flatnonzero((np.arange(len(word)) + width <= (first + words)[row]))
    h = np.zeros(len(whole), np.uint64)
    for i in range(width):
        h += word[whole + i] * factor[i]
    of = row[whole]
    short = np.flatnonzero((words > 0) & (words < width))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i in range(width - 1):
            has = words[short] > i
            extra[has] += word[first[short[has]] + i] * factor[i]
        extra += words[short].astype(np.uint64)
        h, of = np.concatenate([h, extra]), np.concatenate([of, short])
    h = _mix(h)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], of[new]


def levels(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest ``(a + b) // 9`` over the sizes b of parts that are similar to a part of size a."""
    return (a + -(-4 * a // 5)) // 9, (a + 5 * a // 4) // 9


def _enumerated(h: np.ndarray, size: np.ndarray, tag: np.ndarray, k: int, draw: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of parts at level ``k``, and the number of the part of each; ``tag`` has band, cell and level."""
    first = np.cumsum(size) - size
    mixed = _mix(h ^ _ODD)
    if k == 0:
        return _mix(np.add.reduceat(mixed, first) + tag), np.arange(len(size))
    n = k + 2
    lot = (_mix(h + _times(draw + 1)) >> np.uint64(33)) % np.uint64(n)
    sums = [np.add.reduceat(np.where(lot == np.uint64(j), mixed, np.uint64(0)), first) for j in range(n)]
    found, of = [], []
    for number, (i, j) in enumerate(combinations(range(n), 2)):
        held = sums[i] + sums[j]
        mark = _mix(tag + _times(draw * 1009 + number + 1))
        empty = np.flatnonzero(held == 0) if draw < REDRAWS else np.empty(0, np.int64)
        full = held != 0 if draw < REDRAWS else np.ones(len(held), bool)
        found.append(_mix(held[full] + mark[full]))
        of.append(np.flatnonzero(full))
        if len(empty):
            every = np.repeat(first[empty] - np.cumsum(size[empty]) + size[empty], size[empty]) + np.arange(int(size[empty].sum()))
            more, who = _enumerated(h[every], size[empty], mark[empty], k, draw + 1)
            found.append(more)
            of.append(empty[who])
    return np.concatenate(found), np.concatenate(of)


def signatures(h: np.ndarray, row: np.ndarray, rows: int, smallest: int = SMALLEST_CELL) -> tuple[np.ndarray, np.ndarray]:
    """``(signature, row)`` of sets given as by :func:`shingle_hashes`. Similar sets have one in common."""
    n = np.bincount(row, minlength=rows)
    band = np.maximum(np.frexp(n / smallest)[1] - 1, 0)  # 2 ** band cells
    edge = smallest << (band + 1)  # the size at which the next band begins
    found, of = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for b, here in ((band, n > 0), (band + 1, 5 * n >= 4 * edge)):
        at = np.flatnonzero(here[row])
        if not len(at):
            continue
        x, r = h[at], row[at]
        bits = b[r].astype(np.uint64)
        cell = np.where(bits == 0, np.uint64(0), x >> (np.uint64(64) - np.maximum(bits, np.uint64(1))))
        # hashes are sorted inside a row, so those of a cell stand together
        new = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (r[1:] != r[:-1])]))
        size = np.diff(np.append(new, len(x)))
        low, high = levels(size)
        for k in range(int(high.max()) + 1):
            part = np.flatnonzero((low <= k) & (k <= high))
            if not len(part):
                continue
            each = size[part]
            every = np.repeat(new[part] - np.cumsum(each) + each, each) + np.arange(int(each.sum()))
            tag = _mix((cell[new[part]] << np.uint64(6) | bits[new[part]]) * _ODD + np.uint64(k))
            sig, who = _enumerated(x[every], each, tag, k)
            found.append(sig)
            of.append(r[new[part]][who])
    return np.concatenate(found), np.concatenate(of)


def similar(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of sizes a and b with ``shared`` common hashes have a Jaccard similarity of 0.8 or more."""
    return 100 * shared >= 80 * (a + b - shared)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, offsets in byte_slices(batch.column(1)):
            rows = len(offsets) - 1
            h, row = shingle_hashes(data, offsets)
            n = np.bincount(row, minlength=rows)
            cut = np.concatenate([[0], np.cumsum(n)])
            raw = memoryview(h.tobytes())
            digest = [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) if b > a else None for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), pa.array(digest, pa.binary()), pa.array(n, pa.int64())], ["row", "digest", "n"])


def _sharded(sig: np.ndarray, who: np.ndarray, shards: int, crowd: int) -> pa.RecordBatch:
    """Binary rows of signatures and nodes by shard. A crowded signature leaves one entry in its shard, as node -1; its
    nodes come in a row of their own, which goes to any task."""
    # shards are ranges of the upper half; 48 bits travel, and the shard stands for the rest
    shard = ((sig >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    sig = sig & _LOW | shard.astype(np.uint64) << np.uint64(48)
    order = np.argsort(sig)
    new = np.flatnonzero(np.concatenate([[True], np.diff(sig[order]) != 0]))
    size = np.diff(np.append(new, len(sig)))
    crowded = np.zeros(len(sig), bool)
    crowded[order] = np.repeat(size >= crowd, size)
    one = order[new[size >= crowd]]
    rows = []
    if len(one):
        salt = 1 + int(_mix(who[:1].astype(np.uint64))[0] >> np.uint64(40))
        rows.append((0, salt, sig[crowded].tobytes(), who[crowded].tobytes()))
    plain = np.concatenate([np.flatnonzero(~crowded), one])
    plain = plain[np.argsort(shard[plain], kind="stable")]  # a text's entries stay together
    sig, who, shard = sig[plain], np.where(crowded[plain], -1, who[plain]), shard[plain]
    cut = np.searchsorted(shard, np.arange(shards + 1))
    low = sig.view(np.uint8).reshape(-1, 8)[:, :6]
    rows += [(s, 0, low[a:b].tobytes(), who[a:b].tobytes()) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["shard", "salt", "signatures", "nodes"])


def _signed_entries(shards: int, crowd: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, of, held = [], [], 0
        for batch in batches:
            node = batch.column(0).to_numpy()
            for at, data, offsets in byte_slices(batch.column(1)):
                sig, row = signatures(*shingle_hashes(data, offsets), len(offsets) - 1)
                found.append(sig)
                of.append(node[at + row])
                held += len(sig)
                if held >= HELD:
                    yield _sharded(np.concatenate(found), np.concatenate(of), shards, crowd)
                    found, of, held = [], [], 0
        if held:
            yield _sharded(np.concatenate(found), np.concatenate(of), shards, crowd)

    return run


def _shared_entries(crowd: int):
    def run(shard: pa.Table) -> pa.Table:
        """Nodes by signature, of signatures that occur more than once. ``whole`` rows have all nodes of their signature;
        those of larger or crowded signatures come one by one, with the number of those at hand."""
        raw = b"".join(shard["signatures"].to_pylist())
        node = np.frombuffer(b"".join(shard["nodes"].to_pylist()), np.int64)
        plain = not shard["salt"][0].as_py()
        if plain:
            bytes_ = np.zeros((len(node), 8), np.uint8)
            bytes_[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
            sig = bytes_.view(np.uint64).ravel() | np.uint64(shard["shard"][0].as_py() << 48 & (1 << 64) - 1)
        else:
            sig = np.frombuffer(raw, np.uint64)
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        same = sig[1:] == sig[:-1]
        keep = np.zeros(len(sig), bool)
        keep[1:] |= same
        keep[:-1] |= same
        keep |= not plain
        sig, node = sig[keep], node[keep]
        new = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])[: len(sig)])
        size = np.diff(np.append(new, len(sig)))
        # nodes are in order, so an entry that stands for a crowd comes first
        whole = plain & (size <= crowd) & (node[new] >= 0)
        met = size - np.add.reduceat((node < 0).astype(np.int64), new) if len(new) else size
        own = node >= 0
        sig, node, whole, met = sig[own], node[own], np.repeat(whole, size)[own], np.repeat(met, size)[own]
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])[: len(sig)] | ~whole)
        nodes = pa.ListArray.from_arrays(pa.array(np.append(first, len(node)).astype(np.int32)), pa.array(node))
        return pa.table({"signature": pa.array(sig[first].view(np.int64)), "nodes": nodes, "met": pa.array(met[first]), "whole": pa.array(whole[first])})

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole set of each node."""
    for batch in batches:
        for at, data, offsets in byte_slices(batch.column(1)):
            rows = len(offsets) - 1
            h, row = shingle_hashes(data, offsets)
            cut = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])
            raw = memoryview(h.tobytes())
            sets = [raw[8 * a : 8 * b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), pa.array(sets, pa.binary())], ["node", "hashes"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set size and bucket counts of each node; a node has half as many buckets as hashes or more, a power of two."""
    for batch in batches:
        for at, data, offsets in byte_slices(batch.column(1)):
            rows = len(offsets) - 1
            h, row = shingle_hashes(data, offsets)
            n = np.bincount(row, minlength=rows)
            cut = np.concatenate([[0], np.cumsum(n)])
            counts = []
            for i in range(rows):
                buckets = 1 << max(MIN_BUCKET_BITS, int(n[i]).bit_length() - 1)
                found = np.bincount((h[cut[i] : cut[i + 1]] % np.uint64(buckets)).astype(np.int64), minlength=buckets)
                found = np.minimum(found, MOST_COUNTED).astype(np.uint8)
                counts.append((found[0::2] | found[1::2] << 4).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), pa.array(n), pa.array(counts, pa.binary())], ["node", "n", "counts"])


def _buckets(counts: bytes) -> int:
    return 2 * len(counts)


def _folded(counts: bytes, buckets: int) -> np.ndarray:
    """Counts, read from half bytes, of fewer buckets."""
    found = np.empty(_buckets(counts), np.int16)
    packed = np.frombuffer(counts, np.uint8)
    found[0::2], found[1::2] = packed & 15, packed >> 4
    return found.reshape(-1, buckets).sum(axis=0, dtype=np.int16) if len(found) > buckets else found


def _ruled_out(x: list[bytes], y: list[bytes], most: np.ndarray) -> np.ndarray:
    """Pairs whose bucket counts differ by more than ``most``: then so do their sets."""
    out = np.zeros(len(x), bool)
    for i, (a, b) in enumerate(zip(x, y)):
        buckets = min(_buckets(a), _buckets(b))
        out[i] = np.abs(_folded(a, buckets) - _folded(b, buckets)).sum() > most[i]
    return out


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes and bucket counts do not rule them out."""
    for batch in batches:
        a, b, m, n, x, y = batch.columns
        m, n = m.to_numpy(), n.to_numpy()
        fit = np.flatnonzero((4 * n <= 5 * m) & (4 * m <= 5 * n))
        left = ~_ruled_out(x.take(pa.array(fit)).to_pylist(), y.take(pa.array(fit)).to_pylist(), (m + n)[fit] // 9)
        at = pa.array(fit[left])
        yield pa.RecordBatch.from_arrays([a.take(at), b.take(at)], ["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, x, y = batch.columns
        linked, last, left = [], None, np.empty(0, np.uint64)
        for i in range(batch.num_rows):
            if a[i] != last:
                last, left = a[i], np.frombuffer(x[i].as_buffer(), np.uint64)
            right = np.frombuffer(y[i].as_buffer(), np.uint64)
            if 5 * min(len(left), len(right)) < 4 * max(len(left), len(right)):
                continue
            short, long = sorted((left, right), key=len)
            at = np.minimum(np.searchsorted(long, short), len(long) - 1)
            if similar(int((long[at] == short).sum()), len(left), len(right)):
                linked.append(i)
        at = pa.array(linked, pa.int64())
        yield pa.RecordBatch.from_arrays([a.take(at), b.take(at)], ["a", "b"])


def _sides(pairs: DataFrame, of: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """``(a, b)`` with columns of both their nodes."""
    left = of.select(F.col("node").alias("a"), *[F.col(c).alias(x) for c, (x, _) in columns.items()])
    right = of.select(F.col("node").alias("b"), *[F.col(c).alias(y) for c, (_, y) in columns.items()])
    return pairs.join(right, "b").join(left, "a").select("a", "b", *[c for both in columns.values() for c in both])


def _apart(counts: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By how much the counts of pairs of rows differ."""
    out, step = np.empty(len(x), np.int64), max(1, NUMBERS // counts.shape[1])
    for at in range(0, len(x), step):
        out[at : at + step] = np.abs(counts[x[at : at + step]] - counts[y[at : at + step]]).sum(axis=1)
    return out


def _trees(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A label for each row, and the links ``(x, y)`` of trees that connect all that ``linked``, a symmetric matrix, does."""
    label, xs, ys = np.full(len(linked), -1), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for start in range(len(linked)):
        if label[start] >= 0:
            continue
        label[start], turn = start, [start]
        while turn:
            x = turn.pop()
            y = np.flatnonzero(linked[x] & (label < 0))
            label[y] = start
            xs.append(np.full(len(y), x))
            ys.append(y)
            turn += y.tolist()
    return label, np.concatenate(xs), np.concatenate(ys)


def _open_groups(node: np.ndarray, root: np.ndarray, n: np.ndarray, side: np.ndarray, across: bool, counts: list[bytes], hashes: int) -> Iterator[tuple[int, np.ndarray]]:
    """Nodes of one tile that pairs of different components connect which sizes and bucket counts do not rule out, each
    group with the component that most of its nodes have. Groups of more than about ``hashes`` become several, so that any
    two nodes meet in one."""
    x, y = np.triu_indices(len(node), 1)
    keep = (root[x] != root[y]) & (4 * n[y] <= 5 * n[x]) & (4 * n[x] <= 5 * n[y])
    if across:
        keep &= side[x] != side[y]
    x, y = x[keep], y[keep]
    if len(x):
        # sizes of nodes with a common signature are alike, and so are their numbers of buckets
        buckets = min(map(_buckets, counts))
        fine = np.stack([_folded(c, buckets) for c in counts])
        for level in (fine.reshape(len(node), -1, 1 << MIN_BUCKET_BITS).sum(axis=1, dtype=np.int32), fine):
            keep = 9 * _apart(level, x, y) <= n[x] + n[y]
            x, y = x[keep], y[keep]
    if not len(x):
        return
    at, place = np.unique(np.concatenate([x, y]), return_inverse=True)
    linked = np.zeros((len(at), len(at)), bool)
    linked[place[: len(x)], place[len(x) :]] = linked[place[len(x) :], place[: len(x)]] = True
    label = _trees(linked)[0]
    order = np.argsort(label, kind="stable")
    for group in np.split(at[order], np.flatnonzero(np.diff(label[order])) + 1):
        group = group[np.argsort(node[group])]
        piece = 2 * np.cumsum(n[group]) // hashes if n[group].sum() > hashes else np.zeros(len(group), np.int64)
        parts = [node[group[piece == p]] for p in np.unique(piece)]
        roots, times = np.unique(root[group], return_counts=True)
        for part in (np.concatenate(two) for two in combinations(parts, 2)) if len(parts) > 1 else parts:
            yield int(roots[times.argmax()]), part


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that come in order of their keys, and where each key begins and the last ends; a key that ends a batch waits
    for the next batch."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.concat_tables([*held, pa.Table.from_batches([batch])])
        new = np.any([np.diff(rows[k].to_numpy()) != 0 for k in keys], axis=0)
        cut = np.concatenate([[0], np.flatnonzero(new) + 1])
        if len(cut) > 1:
            yield rows.slice(0, cut[-1]), cut
        held = [rows.slice(cut[-1])]
    for rows in held:
        yield rows, np.array([0, rows.num_rows])


def _tiles(hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cut in _runs(batches, TILE):
            i, j, n, node, root, block = (rows[c].to_numpy() for c in ("i", "j", "n", "node", "root", "block"))
            counts, found = rows["counts"].to_pylist(), set()
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                groups = _open_groups(node[a:b], root[a:b], n[a:b], block[a:b], bool(i[a] != j[a]), counts[a:b], hashes)
                # of a group that several tiles hold one is enough
                found.update((most, tuple(nodes.tolist())) for most, nodes in groups)
            most, nodes = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(most, pa.int64()), pa.array(nodes, pa.list_(pa.int64()))], ["most", "nodes"])

    return run


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes any two different rows have in common; a hash of one row alone is left out."""
    n = [len(s) for s in sets]
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times > 1
    number, keep = np.cumsum(several) - 1, several[column]
    of, column = np.repeat(np.arange(len(sets)), n)[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    out, step, columns = np.zeros((len(sets), len(sets))), max(1, NUMBERS // len(sets)), int(several.sum())
    for at in range(0, columns, step):
        a, b = np.searchsorted(column, (at, at + step))
        held = np.zeros((len(sets), min(step, columns - at)), np.float32)
        held[of[a:b], column[a:b] - at] = 1
        out += held @ held.T
    return out


def _group_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In each group links of similar sets that bring components together: enough to connect them, fewer than nodes."""
    for rows, cut in _runs(batches, GROUP):
        node, root = rows["node"].to_numpy(), rows["root"].to_numpy()
        sets = [np.frombuffer(raw, np.uint64) for raw in rows["hashes"].to_pylist()]
        found = [np.empty((0, 2), np.int64)]
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            n = np.array([len(s) for s in sets[a:b]])
            same = root[a:b, None] == root[None, a:b]
            _, x, y = _trees(similar(_shared(sets[a:b]), n[:, None], n[None, :]) | same)
            apart = ~same[x, y]
            found.append(np.stack([node[a + x[apart]], node[a + y[apart]]], axis=1))
        pairs = np.concatenate(found)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _rooted(nodes: DataFrame, member: DataFrame) -> DataFrame:
    """``nodes`` with the root of each, which is the node itself where it has no link."""
    return nodes.join(member, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _placed(followers: DataFrame, member: DataFrame, block: int) -> DataFrame:
    """``(signature, i, j, node, root, block)``: nodes of signatures that still hold several components, dealt to tiles."""
    named = _rooted(followers, member).select("signature", "node", "root")
    open_ = named.groupBy("signature").agg(
        F.count(F.lit(1)).alias("nodes"), F.min("root").alias("low"), F.max("root").alias("high"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("members")
    ).where("low < high")
    # signatures with the same nodes need one look
    open_ = open_.groupBy("nodes", "members").agg(F.min("signature").alias("signature")).select("signature", F.ceil(F.col("nodes") / block).cast("int").alias("blocks"))
    placed = named.join(open_, "signature").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    placed = placed.select("signature", "node", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return placed.select("signature", "node", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def _gathered(groups: DataFrame, sizes: DataFrame, block: int, hashes: int) -> DataFrame:
    """``(merged, group, i, j, node)``: nodes of groups, where groups with the same ``most`` become one, dealt to tiles,
    if that has fewer rows than they have on their own. Nodes that share a group share a group or tile of the result."""
    listed = groups.select("group", "most", F.explode("nodes").alias("node"))
    each = written(listed.groupBy("most", "node").agg(F.count(F.lit(1)).alias("times")).join(sizes, "node"), "open-nodes")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block, 2 * F.sum("n") / hashes)).cast("int")
    merge = each.groupBy("most").agg(F.count(F.lit(1)).alias("nodes"), F.sum("times").alias("times"), blocks.alias("blocks"))
    merge = written(merge.where("nodes * blocks < times").select("most", "blocks"), "merged-groups")
    dealt = each.join(merge, "most").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.select("most", "node", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "blocks")
    # of several blocks each meets itself where it meets others
    dealt = dealt.where("blocks = 1 OR block != other").select(F.lit(True).alias("merged"), F.col("most").alias("group"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node")
    alone = listed.join(merge, "most", "left_anti").select(F.lit(False).alias("merged"), "group", F.lit(0).alias("i"), F.lit(0).alias("j"), "node")
    return dealt.unionByName(alone)


def components(rows: DataFrame, block: int = BLOCK, shard_signatures: int = SHARD_SIGNATURES, crowd: int = CROWD, broadcast_rows: int = BROADCAST_ROWS, group_hashes: int = GROUP_HASHES) -> DataFrame:
    """``(row, n, root)`` of every row of ``(row, text)``: set size, and the same root for rows connected by links.

    ``row`` must be a distinct long, ``rows`` a written table, as it is read several times. Rows with an empty set have
    a null root. Lists of rows are broadcast up to ``broadcast_rows``, so that texts need no shuffle; beyond, texts are
    shuffled by their row.
    """

    def bounded(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= broadcast_rows else df

    def of_nodes(listed: DataFrame, run, shape: str, name: str) -> DataFrame:
        nodes = written(listed.select(F.explode("nodes").alias("node")).distinct(), f"{name}-nodes")
        return written(texts.join(bounded(nodes), "node", "left_semi").mapInArrow(run, shape), name, BATCH)

    ends = F.array("a", "b").alias("nodes")
    marks = written(rows.select("row", "text").mapInArrow(_marks, "row long, digest binary, n long"), "marks", BATCH)
    same = written(marks.where("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.max("n").alias("n")), "nodes")
    total = same.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # of hashes; there is about one signature for each
    texts = rows.select(F.col("row").alias("node"), "text")
    others = written(marks.join(same.select(F.col("node").alias("row")), "row", "left_anti").select(F.col("row").alias("node")), "copies")
    own = texts.join(bounded(others), "node", "left_anti")
    entries = own.mapInArrow(_signed_entries(1 + total // shard_signatures, crowd), "shard long, salt long, signatures binary, nodes binary")
    groups = entries.groupBy("shard", "salt").applyInArrow(_shared_entries(crowd), "signature long, nodes array<long>, met long, whole boolean")
    groups = written(groups, "signature-groups", BATCH)
    # signatures with the same nodes become one, which counts as many times
    alike = groups.where("whole").groupBy("nodes").agg(F.min("signature").alias("signature"), F.sum("met").alias("met"))
    groups = groups.where("NOT whole").select("nodes", "signature", "met").unionByName(alike)
    shared = written(groups.select("signature", F.explode("nodes").alias("node"), "met"), "shared-signatures")

    weight = shared.groupBy("node").agg(F.sum("met").alias("weight"))
    weighed = shared.join(weight, "node")
    leaders = weighed.groupBy("signature").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus")))["minus"].alias("minus"))
    followers = shared.join(leaders.select("signature", (-F.col("minus")).alias("a")), "signature").where("a != node")
    followers = written(followers.select("signature", "node", "a"), "followers")
    stars = written(followers.select("a", F.col("node").alias("b")).distinct(), "leader-pairs")

    looks = of_nodes(stars.select(ends), _counts, "node long, n long, counts binary", "bucket-counts")
    near = _sides(stars, looks, {"n": ("m", "n"), "counts": ("x", "y")}).mapInArrow(_near, "a long, b long")
    near = written(near, "near-leaders", BATCH)
    # Spark brings the sets together, a pair at a time
    met = _sides(near, of_nodes(near.select(ends), _sets, "node long, hashes binary", "leader-sets"), {"hashes": ("x", "y")})
    links = written(met.mapInArrow(_verified, "a long, b long"), "leader-links", BATCH)
    member = connected_components(links)

    # leaders have met all nodes of their signatures
    placed = written(_placed(followers, member, block), "open-signatures")
    rest = placed.join(looks, "node").repartition(*TILE).sortWithinPartitions(*TILE).select(*TILE, "n", "node", "root", "block", "counts")
    rest = rest.mapInArrow(_tiles(group_hashes), "most long, nodes array<long>").distinct()
    rest = written(rest.withColumn("group", F.monotonically_increasing_id()), "open-groups", BATCH)
    rooted = _rooted(same.select("digest", "node"), member).select("digest", "root")
    if rest.limit(1).count():
        sets = of_nodes(rest, _sets, "node long, hashes binary", "open-sets")
        grouped = _rooted(_gathered(rest, looks.select("node", "n"), block, group_hashes), member).join(sets, "node")
        grouped = grouped.repartition(*GROUP).sortWithinPartitions(*GROUP).select(*GROUP, "node", "root", "hashes")
        across = written(grouped.mapInArrow(_group_links, "a long, b long"), "open-links", BATCH)
        # only components that these links bring together are named anew
        sides = [member.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b")]
        across = across.join(sides[0], "a", "left").join(sides[1], "b", "left")
        across = across.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
        upper = connected_components(written(across.where("a != b").distinct(), "open-components"))
        rooted = rooted.join(upper.select(F.col("node").alias("root"), F.col("root").alias("upper")), "root", "left").select("digest", F.coalesce("upper", "root").alias("root"))
    of_set = written(rooted, "roots")
    return marks.join(of_set, "digest", "left").select("row", "n", "root")


def ngram_components(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_shingles, component_id)`` of every row; ``component_id`` is the smallest key connected to it by links.

    Words end at ASCII white space, A-Z are lower-cased. A null or empty text has an empty set and links with nothing.
    Rows that share a key stay rows of their own, but a component is named by keys. A null key names no component; one
    of null keys alone has a null id. Other columns are ignored; an empty table gives no rows.
    """
    numbered = documents.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    numbered = written(numbered, "numbered")
    found = written(components(numbered), "row-components")
    named = numbered.select("row", "key").join(found, "row")
    least = named.where("root IS NOT NULL").groupBy("root").agg(F.min("key").alias("component"))
    alone = F.when(F.col("root").isNull(), F.col("key")).otherwise(F.col("component"))
    return named.join(least, "root", "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), alone.alias("component_id"))


def op11_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with the size of their shingle set and their component."""
    return ngram_components(table(spark, folder, "documents"))
