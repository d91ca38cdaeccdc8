"""SentencePiece encoding and decoding with forward scores shared by common prefixes.

A text is cut into marked words: a run of word marks and the characters up to the next mark. No piece crosses the start
of such a word, so each distinct word is encoded once. The distinct words of a batch are sorted, which is the order of a
depth-first walk through their trie, and the forward chart of a word is kept up to the prefix it shares with the next.

The chart is a Viterbi chart over pieces. For a merge vocabulary the score of a path is decided by its transitions: a
path is the encoding if and only if each two neighbouring pieces encode to themselves when put together. Every prefix
has exactly one such path, so a chart cell holds one last piece. Characters without a piece become byte pieces.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import table

MARK = "▁"
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
CACHED_WORDS = 600_000  # encodings a task keeps between batches


class Pieces:
    """A byte-fallback merge vocabulary read from a SentencePiece model file."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(size)]
        self.plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)) for i in range(size)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        # merges are taken by falling score; of equal scores the leftmost pair goes first
        self.score = {self.text[i]: model.get_score(i) for i in range(size) if self.plain[i]}
        self.id = {self.text[i]: i for i in range(size) if self.plain[i]}
        self.fits: dict[tuple[str, str], bool] = {}
        whole = {p for p in self.id if len(p) == 1 or self._merged(p) == [p]}
        self.whole = whole
        # all parts of pieces, and for those met the pieces they end with
        self.endings = {p[i:j] for p in whole for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
        self.inside: dict[str, list[str]] = {}
        self.utf8 = [bytes([self.of_byte[i]]) if i in self.of_byte else t.encode() for i, t in enumerate(self.text)]

    def _merged(self, text: str) -> list[str]:
        """Plain merging, best pair first; only for pieces and pairs of pieces, which are short."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best = max(((score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in score), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def follows(self, a: str, b: str) -> bool:
        """Whether the two pieces stay apart when they meet."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            known = self.fits[a, b] = self._merged(a + b) == [a, b]
        return known

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Encodings of distinct words, walked in sorted order so that shared prefixes are scored once."""
        out: dict[str, list[int]] = {}
        last: list[str | None] = [None]  # last piece of the encoding of each prefix
        reach = [""]  # longest ending of each prefix that is part of a piece
        before, ids, endings, inside, fits, follows = "", self.id, self.endings, self.inside, self.fits, self.follows
        for word in sorted(words):
            n, shared = len(word), 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], reach[shared + 1 :]
            ending = reach[shared]
            for end in range(shared + 1, n + 1):
                found = word[end - 1]
                ending += found
                while ending and ending not in endings:
                    ending = ending[1:]
                reach.append(ending)
                here = inside.get(ending)
                if here is None:
                    here = inside[ending] = [ending[i:] for i in range(len(ending)) if ending[i:] in self.whole]
                for piece in here:  # longest first
                    left = last[end - len(piece)]
                    if left is None:
                        found = piece
                        break
                    apart = fits.get((left, piece))
                    if follows(left, piece) if apart is None else apart:
                        found = piece
                        break
                last.append(found)
            before = word
            path, end = [], n
            while end:
                piece = last[end]
                known = ids.get(piece)
                if known is None:
                    path.extend(self.byte[b] for b in reversed(piece.encode()))
                else:
                    path.append(known)
                end -= len(piece)
            path.reverse()
            out[word] = path
        return out

    def decode(self, ids) -> str:
        """The text of a sequence of ids: marks become spaces, runs of byte pieces are read as UTF-8."""
        out = b"".join(map(self.utf8.__getitem__, ids))
        text = out.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def marked_words(text: str) -> list[str]:
    """A mark in front, marks for spaces, cut before each run of marks. The empty text has no words."""
    return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []


_OPEN: dict[str, tuple[Pieces, dict[str, bytes]]] = {}


def _opened(path: str) -> tuple[Pieces, dict[str, bytes]]:
    """The vocabulary and the encodings so far, kept from one task of a worker to the next."""
    if path not in _OPEN:
        _OPEN[path] = Pieces(path), {}
    return _OPEN[path]


def _codec(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, cache = _opened(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [t or "" for t in part.column(1).to_pylist()]
                words = [marked_words(t) for t in texts]
                if len(cache) > CACHED_WORDS:
                    cache.clear()
                new = [w for w in set().union(*words) if w not in cache]
                cache.update((w, array("i", ids).tobytes()) for w, ids in pieces.encode_words(new).items())
                ids = [np.frombuffer(b"".join(map(cache.__getitem__, ws)), np.int32) for ws in words]
                ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                        pa.array([pieces.decode(x.tolist()) == t.replace(MARK, " ") for x, t in zip(ids, texts)], pa.bool_()),
                    ],
                    ["key", "ids", "n_ids", "ids_crc32", "restored"],
                )

    return run


def encode(documents: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids, n_ids, ids_crc32, restored)`` of every row, in the given model's ids.

    The ids are those of the model's own library. ``restored`` tells whether decoding gives the text again; a word mark
    in a text reads as a space, as in the library, and that is what is compared. Null and empty texts have no ids.
    Repeated rows and null keys are kept, other columns ignored, an empty table gives no rows. Texts are never cut.
    """
    kind = documents.schema[key].dataType.simpleString()
    shape = f"key {kind}, ids array<int>, n_ids long, ids_crc32 long, restored boolean"
    out = documents.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(_codec(model), shape)
    return out.withColumnRenamed("key", key)


def decode(encoded: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(key, text)`` of rows of ids; null or empty ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, _ = _opened(model)
        for batch in batches:
            texts = [pieces.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    out = encoded.select(F.col(f"`{key}`"), F.col(f"`{ids}`")).mapInArrow(run, f"key {kind}, text string")
    return out.withColumnRenamed("key", key)


def public_model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in ids of the public 32k piece vocabulary, decoded again as a check."""
    return encode(table(spark, folder, "documents"), public_model())
