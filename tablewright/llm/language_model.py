"""Language-model scores from an Elias-Fano n-gram trie.

The n-grams of the training texts form a trie whose levels are split over shard files. Level 1 holds the words, as a
monotone sequence of hashes. A node of a deeper level is a word under a context, which is a node of the level above: the
file has the contexts in rising order, monotone pointers to their successors, and the successors as one monotone
sequence, word numbers relative to the context. Monotone sequences are Elias-Fano coded: packed low bits, and a bit
vector of the high ones. Probabilities are discounted and quantised to 16 bits in the log domain. Tasks map the files
into memory and look n-grams up in sorted order by successor search.

Files are built by Spark: counts are added up by task, shuffled in packed form and merged by shard. A node's shard
depends on context and word together, so a frequent context is spread over all shards.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import crc_of_id, input_partitions, shared_folder, table

ORDER = 2
DISCOUNT = 0.75  # of counts under a context; the same at every size
CHUNK = 6_000_000  # characters that a task counts or scores at a time
END = int(xxhash.xxh64_intdigest("\n"))  # no word holds white space
STEPS = 65_535  # quantised log10 probabilities from 0 down to LEAST
LEAST = -16.0

U64 = np.uint64


def _or_words(place: np.ndarray, bits: np.ndarray, n: int) -> np.ndarray:
    """Words of 64 bits from contributions at rising word places."""
    out = np.zeros(n, U64)
    if len(place):
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        out[place[first]] = np.bitwise_or.reduceat(bits, first)
    return out


class EliasFano:
    """A monotone sequence of integers: ``access`` by place and ``find`` by value, for whole arrays at a time."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.zeros = n, low_bits, low, high, zeros

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values, n = values.astype(U64), len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        at = np.arange(n, dtype=U64)
        part = values & U64((1 << low_bits) - 1)
        bit = at * U64(low_bits)
        word, shift = (bit >> U64(6)).astype(np.int64), bit & U64(63)
        size = (n * low_bits + 63) // 64 + 1
        low = _or_words(word, part << shift, size)
        over = shift + U64(low_bits) > 64
        low |= _or_words(word[over] + 1, part[over] >> (U64(64) - shift[over]), size)
        bit = (values >> U64(low_bits)) + at
        high = _or_words((bit >> U64(6)).astype(np.int64), U64(1) << (bit & U64(63)), (n + (top >> low_bits)) // 64 + 2)
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))])
        return cls(n, low_bits, low, high, zeros)

    def _lows(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), U64)
        bit = at.astype(U64) * U64(self.low_bits)
        word, shift = (bit >> U64(6)).astype(np.int64), bit & U64(63)
        got = self.low[word] >> shift
        over = shift + U64(self.low_bits) > 64
        got[over] |= self.low[word[over] + 1] << (U64(64) - shift[over])
        return got & U64((1 << self.low_bits) - 1)

    @staticmethod
    def _in_word(word: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """Place of the ``nth`` (from 0) one of each word, by halving."""
        at = np.zeros(len(word), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            ones = np.bitwise_count(word & U64((1 << half) - 1)).astype(np.int64)
            up = nth >= ones
            nth = np.where(up, nth - ones, nth)
            at += np.where(up, half, 0)
            word = np.where(up, word >> U64(half), word)
        return at

    def _zero(self, nth: np.ndarray) -> np.ndarray:
        """Ones before the ``nth`` zero of the high bits; ``n`` beyond the last zero."""
        word = np.searchsorted(self.zeros, nth, "right") - 1
        inside = word < len(self.high)
        word = np.minimum(word, len(self.high) - 1)
        bit = word * 64 + self._in_word(~self.high[word], nth - self.zeros[word])
        return np.where(inside, bit - nth, self.n)

    def access(self, at: np.ndarray) -> np.ndarray:
        """Values at the given places."""
        at = np.asarray(at, np.int64)
        ones = np.arange(len(self.high) + 1) * 64 - self.zeros
        word = np.searchsorted(ones, at, "right") - 1
        bit = word * 64 + self._in_word(self.high[word], at - ones[word])
        return ((bit - at).astype(U64) << U64(self.low_bits)) | self._lows(at)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, -1 where it is missing: the bucket of its high bits, then a search among low bits."""
        values = np.asarray(values, U64)
        if not self.n:
            return np.full(len(values), -1, np.int64)
        bucket = np.minimum(values >> U64(self.low_bits), U64(len(self.high) * 64)).astype(np.int64)
        stop = self._zero(bucket)
        start = np.where(bucket > 0, self._zero(np.maximum(bucket - 1, 0)), 0)
        part = values & U64((1 << self.low_bits) - 1)
        end = stop.copy()
        while (open_ := np.flatnonzero(start < stop)).size:
            mid = (start[open_] + stop[open_]) // 2
            less = self._lows(mid) < part[open_]
            start[open_[less]] = mid[less] + 1
            stop[open_[~less]] = mid[~less]
        found = start < end
        found[found] = self._lows(start[found]) == part[found]
        return np.where(found, start, -1)


def _save(path: str, **items) -> None:
    """One file of aligned arrays behind a JSON head; put in place at once, so that a task may run twice."""
    arrays, head, at = [], {}, 0
    for name, x in items.items():
        if isinstance(x, EliasFano):
            head[name] = {"n": x.n, "low_bits": x.low_bits}
            parts = {f"{name}.low": x.low, f"{name}.high": x.high, f"{name}.zeros": x.zeros}
        else:
            parts = {name: x}
        for part, a in parts.items():
            head[part] = {"type": a.dtype.str, "size": len(a), "at": at}
            arrays.append(a)
            at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    with open(f"{path}.{os.getpid()}", "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for a in arrays:
            f.write(a.tobytes() + bytes(-a.nbytes % 8))
    os.replace(f"{path}.{os.getpid()}", path)


class Mapped:
    """A saved file mapped into memory."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        size = int.from_bytes(data[:8].tobytes(), "little")
        head = json.loads(data[8 : 8 + size].tobytes())
        body = data[8 + size :]

        def array(name: str) -> np.ndarray:
            h = head[name]
            kind = np.dtype(h["type"])
            return body[h["at"] : h["at"] + h["size"] * kind.itemsize].view(kind)

        for name, h in head.items():
            if "low_bits" in h:
                setattr(self, name, EliasFano(h["n"], h["low_bits"], *(array(f"{name}.{x}") for x in ("low", "high", "zeros"))))
            elif "." not in name:
                setattr(self, name, array(name))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a.astype(U64) * U64(0x9E3779B97F4A7C15) + b.astype(U64) * U64(0xC2B2AE3D27D4EB4F)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Consecutive ranges of hashes."""
    return ((hashes >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def _lower_bound(shard: int, shards: int) -> int:
    return -(-(shard << 32) // shards) << 32


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(shard[part[0]]), part


def _quantised(p: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(np.log10(np.maximum(p, 1e-300)) / LEAST, 0, 1) * STEPS).astype(np.uint16)


def _value(q: np.ndarray) -> np.ndarray:
    return 10.0 ** (q.astype(np.float64) * (LEAST / STEPS))


class Trie:
    """The files of one model. ``sizes[k]``: nodes of each shard of level ``k + 1``."""

    def __init__(self, folder: str, shards: int, sizes: list[list[int]], tokens: int, words: int):
        self.folder, self.shards, self.sizes, self.tokens, self.words = folder, shards, sizes, tokens, words

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_open"}

    def part(self, level: int, kind: str, shard: int) -> Mapped | None:
        """A file; there is none for a shard whose contexts have no successors at all."""
        opened = self.__dict__.setdefault("_open", {})
        name = f"{self.folder}/{level}-{kind}-{shard}"
        if name not in opened:
            opened[name] = Mapped(name) if kind == "nodes" or os.path.exists(name) else None
        return opened[name]

    def bases(self, level: int) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes[level - 1])]).astype(np.int64)

    def words_of(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for unknown ones."""
        out, bases = np.full(len(hashes), -1, np.int64), self.bases(1)
        for s, part in _by_shard(_shard(hashes, self.shards)):
            at = self.part(1, "nodes", s).hashes.find(hashes[part] - U64(_lower_bound(s, self.shards)))
            out[part] = np.where(at >= 0, at + bases[s], -1)
        return out

    def per_node(self, level: int, nodes: np.ndarray, kind: str, read) -> np.ndarray:
        """``read(file, local place)`` for nodes of a level, 0 for missing ones."""
        out, bases = np.zeros(len(nodes)), self.bases(level)
        known = np.flatnonzero(nodes >= 0)
        shard = np.searchsorted(bases, nodes[known], "right") - 1
        for s, part in _by_shard(shard):
            out[known[part]] = read(self.part(level, kind, s), nodes[known[part]] - bases[s])
        return out

    def counts(self, level: int, nodes: np.ndarray) -> np.ndarray:
        return self.per_node(level, nodes, "nodes", lambda f, at: (f.upto.access(at + 1) - f.upto.access(at)).astype(np.float64))

    def children(self, level: int, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of ``level`` for words under contexts of the level above (-1: none), and their quantised share."""
        out, share, bases = np.full(len(words), -1, np.int64), np.zeros(len(words)), self.bases(level)
        known = np.flatnonzero((contexts >= 0) & (words >= 0))
        shard = _shard(_mix(contexts[known], words[known]), self.shards)
        for s, part in _by_shard(shard):
            file, at = self.part(level, "nodes", s), known[part]
            context = file.contexts.find(contexts[at])
            inside = context >= 0
            node = file.successors.find(context[inside].astype(U64) * U64(self.words) + words[at[inside]].astype(U64))
            found = node >= 0
            at, node = at[inside][found], node[found]
            out[at], share[at] = node + bases[s], _value(file.share[node])
        return out, share

    def probabilities(self, words: np.ndarray, before: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Interpolated probability of each word, and its count. ``before[k]``: context nodes of level ``k + 1``."""
        count = self.counts(1, words)
        # one count of every word goes to the words and the unknown one alike
        p = (np.maximum(count - 1, 0) + self.words / (self.words + 1)) / self.tokens
        for level, context in enumerate(before, 2):
            rest = self.per_node(level - 1, context, "rest", lambda f, at: _value(f.rest[at]) if f else np.ones(len(at)))
            _, share = self.children(level, context, words)
            p = np.where(context >= 0, share + rest * p, p)
        return p, count


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has one row or at most ``CHUNK`` characters."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
        at = 0
        while at < batch.num_rows:
            start = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, start + CHUNK, "right")))
            yield batch.slice(at, end - at)
            at = end


def _tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes; for each token, ends included, its place among them; the tokens of each text."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    flat, parent = words.flatten(), pc.list_parent_indices(words).to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    flat, parent = flat.filter(full).dictionary_encode(), parent[full.to_numpy(zero_copy_only=False)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w) for w in flat.dictionary.to_pylist()), U64, len(flat.dictionary))
    each = np.bincount(parent, minlength=len(text)) + 1
    out = np.full(len(parent) + len(text), len(hashes), np.int64)  # the end follows the words
    out[np.arange(len(parent)) + parent] = flat.indices.to_numpy()
    return np.concatenate([hashes, np.array([END], U64)]), out, each


def _packed(x: np.ndarray) -> bytes:
    """Non-negative integers in the fewest bytes each that hold the largest."""
    for kind in ("<u1", "<u2", "<u4", "<u8"):
        if not len(x) or int(x.max()) <= np.iinfo(kind).max:
            return kind[2].encode() + x.astype(kind).tobytes()
    raise OverflowError


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[:1].decode()}", offset=1).astype(np.int64)


_COUNTS = "shard int, a binary, b binary, n binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), (), ()]
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["shard", "a", "b", "n"])


def _count_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            hashes, tokens, _ = _tokens(chunk.column(1))
            n = np.bincount(tokens, minlength=len(hashes))
            hashes, n = hashes[n > 0], n[n > 0]
            yield _rows([(s, hashes[p].astype("<u8").tobytes(), b"", _packed(n[p])) for s, p in _by_shard(_shard(hashes, shards))])

    return run


_STATS = "shard int, nodes long, total long"


def _stats(shard: int, nodes: int, total: int) -> pa.Table:
    return pa.table([pa.array([shard], pa.int32()), pa.array([nodes], pa.int64()), pa.array([total], pa.int64())], ["shard", "nodes", "total"])


def _merge_words(folder: str, shards: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        hashes = np.concatenate([np.frombuffer(x, "<u8") for x in rows["a"].to_pylist()])
        n = np.concatenate([_unpacked(x) for x in rows["n"].to_pylist()])
        hashes, at = np.unique(hashes, return_inverse=True)
        n = np.bincount(at, weights=n).astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(n)])
        _save(f"{folder}/1-nodes-{shard}", hashes=EliasFano.build(hashes - U64(_lower_bound(shard, shards))), upto=EliasFano.build(upto))
        return _stats(shard, len(hashes), int(upto[-1]))

    return run


def _contexts(trie: Trie, words: np.ndarray, each: np.ndarray, depth: int) -> list[np.ndarray]:
    """Context nodes of levels 1 to ``depth`` before each token. A text begins after the end of another."""
    first = np.concatenate([[0], np.cumsum(each)[:-1]])
    end = trie.words_of(np.array([END], U64))[0]
    before = np.concatenate([[end], words[:-1]])
    before[first] = end
    out = [before]
    place = np.arange(len(words)) - np.repeat(first, each)
    for level in range(2, depth + 1):
        # the context of the token before, with that token: unknown where the text has just begun
        up = np.concatenate([[-1], out[-1][:-1]])
        up[place == 0] = -1
        pairs, at = np.unique(np.stack([up, before], axis=1), axis=0, return_inverse=True)
        out.append(trie.children(level, pairs[:, 0], pairs[:, 1])[0][at.ravel()])
    return out


def _count_children(trie: Trie, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            hashes, tokens, each = _tokens(chunk.column(1))
            words = trie.words_of(hashes)[tokens]
            context = _contexts(trie, words, each, level - 1)[-1]
            words, context = words[context >= 0], context[context >= 0]
            order = np.lexsort((words, context))
            a, b = context[order], words[order]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else order
            n = np.diff(np.concatenate([first, [len(a)]]))
            a, b = a[first], b[first]
            yield _rows([(s, _packed(np.diff(a[p], prepend=0)), _packed(b[p]), _packed(n[p])) for s, p in _by_shard(_shard(_mix(a, b), trie.shards))])

    return run


def _merge_children(trie: Trie, level: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        a = np.concatenate([np.cumsum(_unpacked(x)) for x in rows["a"].to_pylist()])
        b = np.concatenate([_unpacked(x) for x in rows["b"].to_pylist()])
        n = np.concatenate([_unpacked(x) for x in rows["n"].to_pylist()])
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        n = np.add.reduceat(n, first)
        a, b = a[first], b[first]
        contexts, at, width = np.unique(a, return_inverse=True, return_counts=True)
        pointers = np.concatenate([[0], np.cumsum(width)])
        share = np.maximum(n - DISCOUNT, 0) / trie.counts(level - 1, contexts)[at]
        upto = np.concatenate([[0], np.cumsum(n)])
        _save(
            f"{trie.folder}/{level}-nodes-{shard}",
            contexts=EliasFano.build(contexts),
            pointers=EliasFano.build(pointers),
            successors=EliasFano.build(at.astype(U64) * U64(trie.words) + b.astype(U64)),
            share=_quantised(share),
            upto=EliasFano.build(upto),
        )
        return _stats(shard, len(a), int(upto[-1]))

    return run


def _children_per_context(trie: Trie, level: int, shards: int):
    """From each file of a level, how many successors it has for each context, dealt to the files of the contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases = trie.bases(level - 1)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                if not trie.sizes[level - 1][shard]:
                    continue
                file = trie.part(level, "nodes", shard)
                contexts = file.contexts.access(np.arange(file.contexts.n)).astype(np.int64)
                width = np.diff(file.pointers.access(np.arange(file.pointers.n)).astype(np.int64))
                at = np.searchsorted(bases, contexts, "right") - 1
                yield _rows([(s, _packed(np.diff(contexts[p] - bases[s], prepend=0)), b"", _packed(width[p])) for s, p in _by_shard(at)])

    return run


def _merge_rest(trie: Trie, level: int):
    """The share of each context that its discounted successors leave to the level below."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        size, base = trie.sizes[level - 2][shard], trie.bases(level - 1)[shard]
        at = np.concatenate([np.cumsum(_unpacked(x)) for x in rows["a"].to_pylist()])
        width = np.bincount(at, weights=np.concatenate([_unpacked(x) for x in rows["n"].to_pylist()]), minlength=size)
        count = trie.counts(level - 1, np.arange(size) + base)
        # a context that only ever ended its text has no successor and leaves everything
        _save(f"{trie.folder}/{level - 1}-rest-{shard}", rest=_quantised(np.where(width > 0, DISCOUNT * width / np.maximum(count, 1), 1.0)))
        return _stats(shard, size, int(width.sum()))

    return run


def train(documents: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, folder: str | None = None) -> Trie:
    """Build the trie of all n-grams up to ``order`` words in the shared folder. What is kept grows with the texts.

    The driver holds one row of sizes per shard; there are as many shards as tasks read the texts.
    """
    spark = documents.sparkSession
    folder = folder or shared_folder(spark, "trie")
    rows = documents.select(F.col(f"`{key}`"), F.col(f"`{text}`"))
    shards = input_partitions(rows)

    def merged(counts: DataFrame, function) -> list[int]:
        made = counts.repartition(shards, "shard").groupBy("shard").applyInArrow(function, _STATS).collect()
        sizes = [0] * shards
        for row in made:
            sizes[row["shard"]] = row["nodes"]
        trie.tokens = trie.tokens or sum(row["total"] for row in made)
        return sizes

    trie = Trie(folder, shards, [], 0, 0)
    trie.sizes.append(merged(rows.mapInArrow(_count_words(shards), _COUNTS), _merge_words(folder, shards)))
    trie.words = sum(trie.sizes[0])
    for level in range(2, order + 1):
        trie.sizes.append(merged(rows.mapInArrow(_count_children(trie, level), _COUNTS), _merge_children(trie, level)))
        ids = spark.range(0, shards, 1, shards).select(F.col("id").cast("int").alias("shard"))
        merged(ids.mapInArrow(_children_per_context(trie, level, shards), _COUNTS), _merge_rest(trie, level))
    return trie


def _score(trie: Trie):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            hashes, tokens, each = _tokens(chunk.column(1))
            doc = np.repeat(np.arange(len(each)), each)
            if trie.tokens:
                words = trie.words_of(hashes)[tokens]
                order = len(trie.sizes)
                before = _contexts(trie, words, each, order - 1)[: order - 1]
                # the same n-gram is looked up once
                grams, at = _distinct([*before, words])
                p, count = (x[at] for x in trie.probabilities(grams[-1], grams[:-1]))
            else:
                p, count = np.ones(len(tokens)), np.zeros(len(tokens))
            base = np.log10((count + 1) / (trie.tokens + trie.words + 1))
            n = len(each)
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column(0),
                    pa.array(each.astype(np.int64)),
                    pa.array(np.bincount(doc, weights=count > 0, minlength=n).astype(np.int64)),
                    pa.array(np.full(n, trie.tokens, np.int64)),
                    pa.array(np.bincount(doc, weights=base, minlength=n)),
                    pa.array(np.bincount(doc, weights=np.log10(p), minlength=n)),
                ],
                ["key", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def _distinct(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of some columns, sorted, and the place of each row among them."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    return [c[order[new]] for c in columns], at


def score(documents: DataFrame, trie: Trie, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    ``score`` is the log10 probability of the whole text under the model, ``base_score`` that of single words with one
    added to each count. Tokens are runs of anything but ASCII white space after lower-casing A-Z, and one end per text.
    Null and empty texts have the end only. Repeated rows and null keys are kept, other columns ignored; an empty table
    gives no rows. Under a model of no texts every score is 0.
    """
    kind = documents.schema[key].dataType.simpleString()
    shape = f"key {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return documents.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(_score(trie), shape).withColumnRenamed("key", key)


def op3_language_model(spark: SparkSession, folder: str) -> DataFrame:
    """All documents scored by a model of those whose id's CRC-32 leaves a remainder other than 2 on division by 7."""
    documents = table(spark, folder, "documents")
    held_out = crc_of_id() % 7 == 2
    scored = score(documents, train(documents.where(~held_out)))
    return scored.withColumn("held_out", held_out)
