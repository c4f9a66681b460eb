"""Byte-level BPE: encoding with a priority queue over a linked list of symbols, and decoding.

A piece of text starts as a doubly linked list of its bytes. A heap holds the ranks of the adjacent
pairs that can be merged; the lowest rank is merged first, the leftmost of equal ranks before the
others, and entries whose symbols have changed meanwhile are skipped. Ids of pieces are kept in a
table of bounded size. Decoding concatenates the vocabulary strings.

Result: NULL and empty texts have no ids, and no ids give the empty text; repeated rows and extra
columns stay as they are. Strings of special tokens inside a text become those tokens, as in the
library. Ids out of the vocabulary decode to nothing.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.kept import Kept, in_worker, laid, trim

#: Pieces, and words with the space before them, kept in each of two generations.
KEPT = 200_000
#: Texts whose words are looked up together.
TOGETHER = 512
#: Fixed value: how the byte-level pre-tokenizer cuts texts.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_ODD = re.compile(r" (?:\s|$)")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    def __init__(self, path: str, kept: int = KEPT):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for string, i in vocab.items():
            if string not in self.special:
                self.strings[i] = bytes(back[c] for c in string)
        for string, i in self.special.items():
            self.strings[i] = string.encode()
        self.single = [vocab[letters[b]] for b in range(256)]
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in spec["model"]["merges"]]
        self.merged = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.ranks = {(a, b): rank for rank, (a, b, _) in enumerate(self.merged)}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bare, self.spaced = Kept(kept), Kept(kept)
        self.table = np.array(self.strings, object)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ids = [self.single[b] for b in piece]
        n = len(ids)
        rank_of, merged = self.ranks.get, self.merged
        heap = [rank * n + i for i, rank in enumerate(map(rank_of, zip(ids, ids[1:]))) if rank is not None]
        if not heap:
            return ids
        heapq.heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            rank, i = divmod(heapq.heappop(heap), n)
            a, b, new = merged[rank]
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # stale
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = rank_of((new, ids[k]))
                if rank is not None:
                    heapq.heappush(heap, rank * n + i)
            h = before[i]
            if h >= 0:
                rank = rank_of((ids[h], new))
                if rank is not None:
                    heapq.heappush(heap, rank * n + h)
        return [x for x in ids if x >= 0]

    def _pieces(self, texts: list[str]) -> list[bytes]:
        found, bare = [PIECES.findall(t) for t in texts], self.bare
        for p in bare.lacking([p for f in found for p in f]):
            bare[p] = array("i", self.merge(p.encode())).tobytes()
        return [b"".join(map(bare.__getitem__, f)) for f in found]

    def _learn(self, words: list[str]) -> None:
        new = self.spaced.lacking(words)
        self.spaced.update(zip(new, self._pieces([" " + w for w in new]), strict=True))

    def _part(self, text: str) -> bytes:
        if _ODD.search(text):  # white space that the next piece does not take whole
            return self._pieces([text])[0]
        first, *words = text.split(" ")
        self._learn(words)
        return (self._pieces([first])[0] if first else b"") + b"".join(map(self.spaced.__getitem__, words))

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit numbers."""
        if self.cut is None or not self.cut.search(text):
            return self._part(text)
        return b"".join(np.array([self.special[p]], "<i4").tobytes() if p in self.special else self._part(p) for p in self.cut.split(text) if p)

    def encode_each(self, texts: pa.Array) -> list[bytes]:
        """encode() for every text; each distinct word after a space is looked up once."""
        out = [None if not _ODD.search(t) and (self.cut is None or not self.cut.search(t)) else self.encode(t) for t in texts.to_pylist()]
        plain = np.flatnonzero([x is None for x in out])
        words = pc.split_pattern(texts.take(pa.array(plain)), " ")
        flat, ends = words.flatten(), words.offsets.to_numpy()
        later = np.ones(len(flat), bool)
        later[ends[:-1]] = False
        coded = flat.filter(pa.array(later)).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self._learn(distinct)
        rest = laid(pa.array([self.spaced[w] for w in distinct], pa.large_binary()), coded.indices, ends - np.arange(len(ends)))
        for i, first, others in zip(plain.tolist(), self._pieces(flat.take(pa.array(ends[:-1])).to_pylist()), rest, strict=True):
            out[i] = first + others
        return out

    def decode(self, ids: np.ndarray | list[int]) -> str:
        ids = np.asarray(ids, np.int64)
        known = (ids >= 0) & (ids < len(self.table))
        return b"".join(self.table[ids if known.all() else ids[known]].tolist()).decode("utf-8", "replace")


@in_worker
def codec(path: str) -> Codec:
    return Codec(path)


def as_lists(parts: list[bytes]) -> pa.Array:
    """Ids of texts as an array of lists."""
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32()))


def encode(docs: DataFrame, path: str, column: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``column`` as an array of int; one pass, no shuffle."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        one = codec(path)
        return as_lists([x for at in range(0, len(texts), TOGETHER) for x in one.encode_each(texts.slice(at, TOGETHER))])

    return docs.withColumn(into, ids(F.coalesce(F.col(column), F.lit(""))))


def decode(docs: DataFrame, path: str, column: str = "ids", into: str = "decoded") -> DataFrame:
    """``docs`` with the text of the ids in ``column``; bytes that are not UTF-8 become U+FFFD."""

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        one = codec(path)
        flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
        return pa.array([one.decode(flat[a:b]) for a, b in pairwise(ends)], pa.string())

    return docs.withColumn(into, text(F.coalesce(F.col(column), F.array().cast("array<int>"))))


def round_trip(docs: DataFrame, path: str, column: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the ids of ``column`` and the text that these decode to, as encode() and decode() give them, in one pass."""

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def both(texts: pa.Array) -> pa.Array:
        one, raw, back = codec(path), [], []
        for at in range(0, len(texts), TOGETHER):
            found = one.encode_each(texts.slice(at, TOGETHER))
            back += [one.decode(np.frombuffer(p, "<i4")) for p in found]
            raw += found
        out = pa.StructArray.from_arrays([as_lists(raw), pa.array(back, pa.string())], names=["ids", "decoded"])
        trim()
        return out

    found = docs.withColumn("__both", both(F.coalesce(F.col(column), F.lit(""))))
    return found.withColumns({ids: F.col("__both.ids"), decoded: F.col("__both.decoded")}).drop("__both")
