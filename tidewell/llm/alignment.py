"""Alignment of two tokenizers over the same bytes, by pointer jumping.

Tokenizer A is byte-level BPE and reads a space and the text; tokenizer B is a sentencepiece model and reads the text,
before which it puts that space itself. A text is cut before every single space between other characters: tokens of
neither side cross such a cut (the vocabulary of B is checked for it, A's own cuts are there too). Pieces between cuts recur, so
each is encoded and aligned once and kept in a table of bounded size.

New pieces are aligned together, as arrays: every token points to its farthest-right overlapping token, which is the
token of the other side that holds its last byte. Where both end there, A's token points to B's and B's to itself.
Successors are doubled (``to = to[to]``) until nothing changes; then every token points to the last token of B in its
component, which labels its group. A token of A and one of B that end together are a link.

The strings of two linked tokens end together, so one is a suffix of the other. This bounds the pairs of ids that can
ever be linked by the vocabularies alone (``Codes.pairs``, some hundred thousand), whatever the corpus: links are
numbers in that table, and its counts over all documents are what is sent to the tasks of the second pass.

Result: one row for each row of ``docs`` (doc_id, text), repeated rows and NULL ids included. A text that is NULL or empty, or
that the tokens of either side do not give back byte for byte (as one with U+2581), has no tokens: zeros and empty strings.
Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, compress, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.byte_bpe import Codec, codec
from tidewell.llm.kept import Kept, give_up, in_worker
from tidewell.llm.stored import stored_table
from tidewell.llm.words import slices

MARK = "▁"
#: Pieces kept in each of two generations of the table, and texts taken out of a batch at once.
KEPT, ROWS = 50_000, 256
#: Rows whose links are looked up together.
LOOKED_UP = 512
#: New pieces aligned at once, and texts of about this many bytes taken together.
AT_ONCE, BYTES = 8192, 1 << 21
_CUT = re.compile(r"(?<! ) (?=\S)")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_encoder(one: Codec):
    """A function from a text to its ids, special strings being plain text, for a vocabulary whose ids follow the ranks of its merges."""
    import public_tokenizers
    import tiktoken

    made = [new for _, _, new in one.merged]
    if sorted(one.single) != list(range(256)) or made != list(range(256, 256 + len(made))):
        raise ValueError("ids do not follow the ranks of the merges")
    ranks = {one.strings[i]: i for i in range(256 + len(made))}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def suffix_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Numbers a_id * len(b) + b_id, ascending, of all pairs of strings of which one is a suffix of the other."""
    found = set()
    for of, other, number in ((a, b, lambda i, j: i * len(b) + j), (b, a, lambda i, j: j * len(b) + i)):
        ids: dict[bytes, list[int]] = {}
        for j, string in enumerate(other):
            ids.setdefault(string, []).append(j)
        for i, string in enumerate(of):
            for at in range(len(string)):
                found.update(number(i, j) for j in ids.get(string[at:], ()))
    return np.array(sorted(found), np.int64)


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the tokens of A and of B, the last token of B in their component; both sides cover the same bytes.

    ``ends_*`` are the ascending ends of the tokens, the last of both being equal.
    """
    n = len(ends_a)
    over_a, over_b = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)
    own_b = np.arange(n, n + len(ends_b))
    to = np.concatenate([over_a + n, np.where(ends_a[over_b] > ends_b, over_b, own_b)])
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to[:n] - n, to[n:] - n
        to = further


def blocks(text: str) -> Iterator[str]:
    """A space and ``text`` in blocks of about ``BYTES`` characters that end at cuts."""
    text, at = " " + text, 0
    while len(text) - at > BYTES and (cut := _CUT.search(text, at + BYTES)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def block_groups(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """The blocks of all texts that can have tokens, with the text's number, in groups of bounded size."""
    group, size = [], 0
    for i, text in enumerate(texts):
        for block in blocks(text) if text and MARK not in text else ():
            if size and size + len(block) > BYTES:
                yield group
                group, size = [], 0
            group.append((i, block))
            size += len(block)
    if group:
        yield group


class Codes:
    """Pieces of text under both tokenizers, and how their tokens align."""

    def __init__(self, path_a: str, path_b: str, kept: int = KEPT):
        import sentencepiece

        self.a = codec(path_a)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a vocabulary string spans two words")
        byte = [_BYTE.fullmatch(p) if self.model.is_byte(i) else None for i, p in enumerate(pieces)]
        self.strings_a = self.a.strings
        self.strings_b = [bytes([int(m[1], 16)]) if m else p.replace(MARK, " ").encode() for m, p in zip(byte, pieces, strict=True)]
        self.size_a, self.size_b = (np.array([len(s) for s in strings], np.int64) for strings in (self.strings_a, self.strings_b))
        self.encode_a = byte_encoder(self.a)
        self.pairs = suffix_pairs(self.strings_a, self.strings_b)
        #: How an id is written, by what follows it: for A another id of A or the first of B, for B another id of B, the next group or nothing.
        self.written = np.array([f"{i}{c}" for n, marks in ((len(self.strings_a), ",|"), (len(self.strings_b), (",", ";", ""))) for c in marks for i in range(n)], object)
        #: piece: (tokens of A, tokens of B, groups, links as little-endian 32-bit numbers), or None where bytes differ.
        self.table: Kept = Kept(kept)

    def pieces(self, text: str) -> list[str]:
        """The pieces of a space and a text, or of the text from a cut on, each without the space before it."""
        first, *rest = _CUT.split(text)
        return [first[1:], *rest] if first else rest

    def learn(self, pieces: list[str]) -> None:
        """Encodes and aligns new pieces."""
        raw = [(" " + p).encode() for p in pieces]
        ids_a, ids_b = list(map(self.encode_a, [" " + p for p in pieces])), self.model.encode(pieces, num_threads=1)
        same = [self.same(*one) for one in zip(raw, ids_a, ids_b, strict=True)]
        self.table.update((p, None) for p, yes in zip(pieces, same, strict=True) if not yes)
        pieces, ids_a, ids_b = (list(compress(x, same)) for x in (pieces, ids_a, ids_b))
        if not pieces:
            return
        count_a, count_b = list(map(len, ids_a)), list(map(len, ids_b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        last_a, last_b = terminals(np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b]))
        stop_b = np.flatnonzero(last_b == np.arange(len(last_b)))  # the tokens of B that end a group
        stop_a = np.searchsorted(last_a, stop_b, "right") - 1
        links = np.searchsorted(self.pairs, flat_a[stop_a] * len(self.strings_b) + flat_b[stop_b]).astype("<i4")
        end_b = np.cumsum(count_b)
        # written group by group, A before B
        mark_a, mark_b = np.zeros(len(flat_a), np.int64), np.zeros(len(flat_b), np.int64)
        mark_a[stop_a], mark_b[stop_b], mark_b[end_b - 1] = 1, 1, 2
        n_a, n_b = len(self.strings_a), len(self.strings_b)
        group_a, group_b = np.searchsorted(stop_a, np.arange(len(flat_a))), np.searchsorted(stop_b, np.arange(len(flat_b)))
        written = np.empty(len(flat_a) + len(flat_b), np.int64)
        written[np.arange(len(flat_a)) + np.concatenate([[0], stop_b + 1])[group_a]] = mark_a * n_a + flat_a
        written[np.arange(len(flat_b)) + stop_a[group_b] + 1] = 2 * n_a + mark_b * n_b + flat_b
        parts = self.written[written].tolist()
        done = np.searchsorted(stop_b, end_b).tolist()
        at = group = 0
        for piece, a, b, to in zip(pieces, count_a, count_b, done, strict=True):
            self.table[piece] = (a, b, "".join(parts[at : at + a + b]), links[group:to].tobytes())
            at, group = at + a + b, to

    def same(self, raw: bytes, ids_a: list[int], ids_b: list[int]) -> bool:
        """Whether both sides give the bytes of a piece."""
        a, b = self.strings_a, self.strings_b
        return b"".join([a[i] for i in ids_a]) == raw == b"".join([b[i] for i in ids_b])

    def align(self, texts: list[str]) -> list[tuple[int, int, str, bytes]]:
        """Tokens of A and of B, groups and links of each text."""
        found: list[list] = [[] for _ in texts]
        bad = set()
        for part in block_groups(texts):
            cut = [(i, self.pieces(block)) for i, block in part]
            new = self.table.lacking([p for _, pieces in cut for p in pieces])
            for at in range(0, len(new), AT_ONCE):
                self.learn(new[at : at + AT_ONCE])
            for i, pieces in cut:
                parts = [self.table[p] for p in pieces]
                if None in parts:
                    bad.add(i)
                elif parts:
                    n_a, n_b, groups, links = zip(*parts, strict=True)
                    found[i].append((sum(n_a), sum(n_b), ";".join(groups), b"".join(links)))
        none = (0, 0, "", b"")
        return [
            none if i in bad or not parts else (sum(p[0] for p in parts), sum(p[1] for p in parts), ";".join(p[2] for p in parts), b"".join(p[3] for p in parts))
            for i, parts in enumerate(found)
        ]


@in_worker
def codes(path_a: str, path_b: str) -> Codes:
    return Codes(path_a, path_b)


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, groups (``a1,a2|b1;a3|b2,b3``) and links (numbers in ``Codes.pairs``) of every row; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = codes(path_a, path_b)
        for batch in slices(batches, ROWS):
            size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy().astype(np.int64))
            cuts = [0, *(np.flatnonzero(np.diff(size // BYTES)) + 1).tolist(), batch.num_rows]
            for at, to in pairwise(cuts):
                rows = batch.slice(at, to - at)
                found = both.align(rows.column("text").to_pylist())
                links = np.frombuffer(b"".join([f[3] for f in found]), "<i4")
                ends = np.cumsum([0, *(len(f[3]) // 4 for f in found)])
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"),
                        pa.array([f[0] for f in found], pa.int64()),
                        pa.array([f[1] for f in found], pa.int64()),
                        pa.array([f[2] for f in found], pa.string()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(links, pa.int32())),
                    ],
                    names=["doc_id", "n_a", "n_b", "groups", "links"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_a long, n_b long, groups string, links array<int>")


def link_counts(found: DataFrame) -> DataFrame:
    """(pair, n): how often each pair is linked in all rows of aligned(); added up in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()  # the pieces of the first pass
        total = np.zeros(0, np.int64)
        for batch in slices(batches, LOOKED_UP):
            now = np.bincount(batch.column("links").flatten().to_numpy(), minlength=len(total))
            now[: len(total)] += total
            total = now
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int32()), pa.array(total[pair], pa.int64())], names=["pair", "n"])

    return found.select("links").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def scored(found: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``found`` (links and other columns) with n_links, count_sum and n_best in place of links.

    The counts reach the driver and every task: two numbers for each pair that the vocabularies allow, at most.
    """
    both = codes(path_a, path_b)
    rows = link_counts(found).toPandas()
    count = np.zeros(len(both.pairs), np.int64)
    count[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    ids = both.pairs % len(both.strings_b)
    highest = np.zeros(len(both.strings_b), np.int64)
    np.maximum.at(highest, ids, count)
    sent = found.sparkSession.sparkContext.broadcast((count, (count == highest[ids]).astype(np.int64)))
    rest = [c for c in found.columns if c != "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        for batch in slices(batches, LOOKED_UP):
            links = batch.column("links")
            ends = links.offsets.to_numpy()
            flat = links.values.to_numpy()[ends[0] : ends[-1]]
            ends = ends - ends[0]
            sums = []
            for values in sent.value:
                total = np.concatenate([[0], np.cumsum(values[flat])])
                sums.append(pa.array(np.diff(total[ends]), pa.int64()))
            n = pa.array(np.diff(ends).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), n, *sums], names=[*rest, "n_links", "count_sum", "n_best"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name != "links")
    return found.mapInArrow(run, f"{fields}, n_links long, count_sum long, n_best long")


def alignment_report(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, tokens, groups and links of each row, with the links' counts over all rows and the name of the groups.

    The links are written once in the shared folder, as the counts must be known before they are looked up.
    """
    named = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    found = stored_table(aligned(docs, path_a, path_b).select("doc_id", "n_a", "n_b", F.size("links").cast("long").alias("n_groups"), named, "links"))
    return scored(found, path_a, path_b).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
