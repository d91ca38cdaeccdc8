"""Token-id output: one wavelet matrix per shard.

A shard holds the ids of consecutive documents. Its wavelet matrix has one bit-plane per bit of the id, each with the
ids stably sorted by the bits above, and running counts for rank. From the one compressed file come tokens by place,
counts of an id in a range, the place of its n-th occurrence, and the whole sequence.

Layout of a file, little-endian: magic ``TWM1``; u8 bits per id; u64 ids; u64 documents; then a zstandard frame with the
end places of the documents (u64 each), the zeros of each plane (u64 each) and the planes (packed, 8-byte padded).
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.common import input_partitions, table, written
from tablewright.llm.words import byte_slices

MAGIC = b"TWM1"
SHARD_TOKENS = 1 << 21
END_ID = 0
BATCH_BYTES = 8 << 20  # of texts encoded at a time; a longer text is encoded alone
JOINED = 200  # new chunks encoded as one text
_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]"
_LOOSE = rf"{_SPACE}(?:{_SPACE}|\z)"
#: Bytes where a text may be cut: 1 before a space, 2 around a line end, 3 before a stop or comma.
_CUT = np.zeros(256, np.uint8)
_CUT[[32, 10, 46, 44]] = 1, 2, 3, 3
_STOP_IN_RUN = r"(?:^|[^\p{L}\p{N}])[.,]"  # a stop that does not follow a letter or number


class WaveletMatrix:
    """Succinct sequence of ids with rank and select; see the module for the file layout."""

    def __init__(self, bits: int, n: int, ends: np.ndarray, zeros: np.ndarray, planes: list[np.ndarray]):
        self.bits, self.n, self.ends, self.zeros, self.planes = bits, n, ends, zeros, planes
        self._ranks: list[np.ndarray] | None = None

    @classmethod
    def build(cls, ids: np.ndarray, ends: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        zeros, planes, now = [], [], ids.astype(np.uint16 if bits <= 16 else np.uint32)
        moved = np.empty_like(now)
        for level in range(bits - 1, -1, -1):
            one = (now & now.dtype.type(1 << level)).astype(bool)
            planes.append(cls._pack(one))
            ones = np.flatnonzero(one)
            zeros.append(len(now) - len(ones))
            np.take(now, np.flatnonzero(~one), out=moved[: zeros[-1]], mode="clip")
            np.take(now, ones, out=moved[zeros[-1] :], mode="clip")
            now, moved = moved, now
        return cls(bits, len(ids), np.asarray(ends, np.uint64), np.array(zeros, np.uint64), planes)

    @staticmethod
    def _pack(one: np.ndarray) -> np.ndarray:
        packed = np.packbits(one, bitorder="little")
        return np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)])

    def to_bytes(self) -> bytes:
        body = b"".join([self.ends.astype("<u8").tobytes(), self.zeros.astype("<u8").tobytes(), *(p.tobytes() for p in self.planes)])
        return MAGIC + struct.pack("<BQQ", self.bits, self.n, len(self.ends)) + zstandard.ZstdCompressor(level=1).compress(body)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        bits, n, docs = struct.unpack_from("<BQQ", data, 4)
        body = zstandard.ZstdDecompressor().decompress(data[21:])
        ends = np.frombuffer(body, "<u8", docs)
        zeros = np.frombuffer(body, "<u8", bits, docs * 8)
        size = -(-n // 64) * 8
        planes = [np.frombuffer(body, np.uint8, size, (docs + bits) * 8 + i * size) for i in range(bits)]
        return cls(bits, n, ends, zeros, planes)

    def _rank1(self, level: int, at: int) -> int:
        """Ones before place ``at`` of a plane."""
        if self._ranks is None:
            self._ranks = [np.concatenate([[0], np.cumsum(np.bitwise_count(p.view("<u8")))]) for p in self.planes]
        word, bit = divmod(at, 64)
        inside = int(self.planes[level].view("<u8")[word]) & ((1 << bit) - 1) if bit else 0
        return int(self._ranks[level][word]) + inside.bit_count()

    def _select(self, level: int, value: int, nth: int) -> int:
        """Place of the ``nth`` (from 0) bit of the given value in a plane."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self._rank1(level, mid + 1)
            if (ones if value else mid + 1 - ones) <= nth:
                low = mid + 1
            else:
                high = mid
        return low

    def access(self, at: int) -> int:
        value = 0
        for level in range(self.bits):
            ones = self._rank1(level, at)
            bit = self.planes[level][at >> 3] >> (at & 7) & 1
            at = int(self.zeros[level]) + ones if bit else at - ones
            value = value << 1 | int(bit)
        return value

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._rank1(level, start), self._rank1(level, stop)
            if token >> (self.bits - 1 - level) & 1:
                start, stop = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of a token in a range of places."""
        if token < 0 or token >> self.bits:
            return 0
        a, b = self._range(token, start, self.n if stop is None else stop)
        return b - a

    def find(self, token: int, nth: int) -> int:
        """Place of the ``nth`` (from 0) occurrence of a token; -1 if there are fewer."""
        if nth < 0 or nth >= self.count(token):
            return -1
        at = self._range(token, 0, self.n)[0] + nth
        for level in range(self.bits - 1, -1, -1):
            zeros = int(self.zeros[level])
            at = self._select(level, 1, at - zeros) if token >> (self.bits - 1 - level) & 1 else self._select(level, 0, at)
        return at

    def all(self) -> np.ndarray:
        """The whole sequence: planes undone from the last to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        out, back = np.zeros(self.n, kind), np.empty(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            zeros = int(self.zeros[level])
            back[np.flatnonzero(~one)] = out[:zeros]
            back[np.flatnonzero(one)] = out[zeros:] | kind(1 << (self.bits - 1 - level))
            out, back = back, out
        return out.astype(np.uint32)


class ChunkEncoder:
    """Whole texts through a byte-level tokenizer, each distinct space-led chunk only once.

    The tokenizer's own word pattern never reaches across a line end, or a space, that stands between other characters,
    so a text may be cut there; nor across the start of a stop or comma that follows a letter or number. Texts with two
    white-space characters in a row, or one at their end, are given to it whole; those where a stop or comma follows
    something else are cut at spaces and line ends alone. The encodings of ``cached`` chunks are kept (about 200 MB),
    also from one task of a worker to the next. New chunks are encoded many at a time, put together where they may be
    cut; the bytes of each id tell them apart again. A tokenizer with another word pattern gets all texts whole.
    """

    def __init__(self, path: str, cached: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cached, self.cache = cached, {}
        shape = json.loads(self.tokenizer.to_str())
        before = shape["pre_tokenizer"] or {}
        self.cuts = shape["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for piece, i in vocabulary.items():
            self.bytes_of[i] = len(piece)  # a byte-level piece has a character for each byte
        for added in shape["added_tokens"]:
            self.bytes_of[added["id"]] = len(added["content"].encode())

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, chunks: list[str], between: str) -> list[bytes]:
        """Encodings of chunks that the word pattern keeps apart when they are joined by ``between``."""
        found = []
        for at in range(0, len(chunks), JOINED):
            part = chunks[at : at + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([between.join(part)], add_special_tokens=False)[0].ids, "<u4")
            upto = np.concatenate([[0], np.cumsum(self.bytes_of[ids])])
            size = np.fromiter((len(c.encode()) for c in part), np.int64, len(part))
            end = np.cumsum(size + len(between)) - len(between)
            first, last = np.searchsorted(upto, end - size), np.searchsorted(upto, end)
            if upto[-1] == end[-1] and (upto[first] == end - size).all() and (upto[last] == end).all():
                raw = memoryview(ids.tobytes())
                found += [bytes(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), last.tolist())]
            else:  # something else joins them, such as an added token
                found += [x.astype("<u4").tobytes() for x in self._whole(part)]
        return found

    def _learn(self, chunks: list[str]) -> None:
        spaced = [c for c in chunks if c[0] == " " and len(c) > 1 and "\n" not in c]
        plain = [c for c in chunks if c[0] not in " \n" and "\n" not in c]
        rest = [c for c in chunks if "\n" in c or c == " "]
        for some, between in ((spaced, ""), (plain, "\n")):
            self.cache.update(zip(some, self._joined(some, between)))
        self.cache.update(zip(rest, (x.astype("<u4").tobytes() for x in self._whole(rest))))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text as uint32; a null text has none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.cuts:
            return self._whole(texts.to_pylist())
        if len(self.cache) > self.cached:
            self.cache.clear()
        loose = pc.match_substring_regex(texts, _LOOSE).to_numpy(zero_copy_only=False)
        stops = ~pc.match_substring_regex(texts, _STOP_IN_RUN).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        for at, data, offsets in byte_slices(texts, BATCH_BYTES):
            rows = len(offsets) - 1
            mine = slice(at, at + rows)
            # where chunks begin: at spaces, before and after line ends, and at stops where they may
            kind = _CUT[data]
            first = kind > 0
            first &= (kind != 3) | np.repeat(stops[mine], np.diff(offsets))
            first[1:] |= kind[:-1] == 2
            starts = offsets[:-1][np.diff(offsets) > 0]
            first[starts] = True
            begin = np.flatnonzero(first)
            ends = np.append(begin[1:], len(data)).astype(np.int64)
            chunks = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(data)).astype(np.int64)), pa.py_buffer(data))
            skipped = np.repeat(loose[mine], np.diff(offsets))[begin]
            flat = chunks.filter(pa.array(~skipped)).dictionary_encode()
            names, cache = flat.dictionary.to_numpy(zero_copy_only=False).tolist(), self.cache
            self._learn([c for c in names if c not in cache])
            found = list(map(cache.__getitem__, names))
            size = np.fromiter(map(len, found), np.int64, len(found)) // 4
            known, start = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size
            # each chunk's ids in the place of the chunk
            which = flat.indices.to_numpy()
            each = size[which]
            upto = np.cumsum(each) - each
            ids = known[np.arange(int(each.sum())) + np.repeat(start[which] - upto, each)]
            row = np.searchsorted(offsets, ends[~skipped] - 1, "right") - 1
            cut = np.cumsum(np.bincount(row, each, rows).astype(np.int64))[:-1]
            out[mine] = np.split(ids, cut)
        whole = np.flatnonzero(loose).tolist()
        for i, x in zip(whole, self._whole(texts.take(pa.array(whole, pa.int64())).to_pylist()) if whole else ()):
            out[i] = x
        return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def _shards(path: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        ids, keys, ends, total = [], [], [], 0
        if path not in _ENCODERS:
            _ENCODERS[path] = ChunkEncoder(path)
        encoder = _ENCODERS[path]

        def shard() -> pa.RecordBatch:
            made = WaveletMatrix.build(np.concatenate(ids), np.array(ends)).to_bytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([keys[0]], kind), pa.array([total], pa.int64()), pa.array([keys], pa.list_(kind)), pa.array([made], pa.binary())],
                ["first_key", "n_tokens", "keys", "file"],
            )

        kind = pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH_BYTES, "right")))
                part, at = batch.slice(at, stop - at), stop
                for key, x in zip(part.column(0).to_pylist(), encoder.encode(part.column(1))):
                    ids += [x, np.array([end_id], np.uint32)]
                    total += len(x) + 1
                    keys.append(key)
                    ends.append(total)
                    if total >= shard_tokens:
                        yield shard()
                        ids, keys, ends, total = [], [], [], 0
        if keys:
            yield shard()

    return run


def write_token_files(documents: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode all texts, in ascending order of the key, into wavelet-matrix files of about ``shard_tokens`` ids.

    Returns the written table ``(part, first_key, n_tokens, keys, file)``, one row per shard in the shared folder; its
    ``file`` column is the file's content. A null or empty text has the end id only. Rows with equal keys follow each
    other in order of their texts; null keys come first. Other columns are ignored; an empty table gives no shards.
    """
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    order = ["key", F.xxhash64("text"), "text"]
    ordered = rows.repartitionByRange(input_partitions(documents), *order[:2]).sortWithinPartitions(*order)
    shards = ordered.mapInArrow(_shards(tokenizer, end_id, shard_tokens), f"first_key {kind}, n_tokens long, keys array<{kind}>, file binary")
    # within a partition this id follows the order of the rows, over partitions that of the ranges
    return written(shards.withColumn("part", F.monotonically_increasing_id()), "token-files")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, keys, data in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            matrix = WaveletMatrix.from_bytes(data.as_py())
            ids, ends = matrix.all().astype("<u4"), matrix.ends.astype(np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            view = memoryview(ids.tobytes())
            crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            out = [keys.values, pa.array(start + starts), pa.array(ends - starts), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, ["key", "start", "n_tokens", "ids_crc32"])


def read_token_files(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, start, n_tokens, ids_crc32)`` of every document, read from the files' contents.

    ``start`` counts the ids of all documents before it. The running sum goes over one small row per shard.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    at = files.select("part", "n_tokens").withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).drop("n_tokens")
    kind = files.schema["first_key"].dataType.simpleString()
    placed = files.join(at, "part").select("start", "keys", "file")
    out = placed.mapInArrow(_documents, f"key {kind}, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("key", key)


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """All documents encoded, written as wavelet-matrix files in ascending order of their ids, and read back."""
    return read_token_files(write_token_files(table(spark, folder, "documents"), public_tokenizer()))
