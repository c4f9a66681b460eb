"""Packing of token sequences by a configuration linear program.

Only the histogram of piece lengths is gathered: at most ``capacity`` numbers, whatever the input.
Over it, a configuration linear program (use patterns of lengths that fit one sequence, as few as
possible, so that every length is covered) is solved by multiplicative weights: each round a knapsack
dynamic program prices the best pattern around every length under the current weights, the lengths that
are covered least use theirs, and weights shrink as lengths are covered, until all are. The fractional
solution is rounded down, the program is solved again for what that leaves, and best fit packs the last
pieces, whose patterns would waste room. Where lengths admit no nearly full packing (many just over half
a sequence), best fit alone may need fewer sequences and then counts. The plan says, for each length, which ranks go to which sequences
at which offset. Its size depends on the lengths, not on how many pieces there are. Spark
numbers the pieces of each length, in salted slices so that a common length is split, and looks every
piece up in the plan.

Result: one row for each piece, so repeated rows are packed separately; a NULL or empty text is the
end token alone; other columns are not looked at. No input gives no sequence.
"""

from __future__ import annotations

import math
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.byte_bpe import byte_letters
from tidewell.llm.kept import Kept, in_worker, laid
from tidewell.llm.words import groups, slices

CAPACITY = 2048
KEPT = 150_000
#: Letters below U+0300 (no normalisation applies, one lower-case letter each), and the punctuation that may follow them in a word.
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-įı-ʯ]+", ".,;:!?"
#: What a length is covered by in one round, how fast weights shrink, and how much they count beside the length: less than
#: one token a sequence, so that full patterns are priced first and weights decide among them.
SHARE, RATE, NUDGE = 0.1, 2.0, 4e-4
#: Room, as a share of the capacity, that a pattern of the program may leave. Where the first needs more sequences than the bound
#: (all tokens over the capacity) and that share of it, the second and best fit alone are tried too; the plan with the fewest counts.
WASTES = (0.001, 1.0)
#: Pieces of one length that one task numbers.
SLICE = 50_000

PIECES = "doc_id long, piece int, start long, length long, ids binary"


class Tokens:
    """Ids of texts as little-endian 32-bit numbers, by a lower-casing tokenizer that cuts at white space.

    Letters and the punctuation after them are pieces of their own for this tokenizer, so words are looked up
    as lower-case letters and punctuation; any other word is looked up whole. Ids of new entries come from
    the library.
    """

    def __init__(self, path: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.letters = byte_letters()
        self.words, self.parts = Kept(kept), Kept(2 * kept)

    def many(self, letters: list[str]) -> list[bytes]:
        """Ids of words of lower-case letters: these are one piece each, so the library's merges alone are needed."""
        tokenize, spelled = self.tokenizer.model.tokenize, self.letters
        raw = (w if w.isascii() else "".join(spelled[b] for b in w.encode()) for w in letters)
        return [array("I", [t.id for t in tokenize(w)]).tobytes() for w in raw]

    def whole(self, words: list[str]) -> list[bytes]:
        """Ids of any words."""
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def forget(self) -> None:
        """Gives up what was not used lately, as the worker may run other stages next."""
        self.words.old, self.parts.old = {}, {}

    def of(self, text: bytes) -> bytes:
        return self.of_each(pa.array([text.decode()]))[0]

    def of_each(self, texts: pa.Array) -> list[bytes]:
        """Ids of every text; each distinct word is put together once."""
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        return laid(self.of_words(coded.dictionary), coded.indices, words.offsets.to_numpy())

    def of_words(self, words: pa.Array) -> pa.Array:
        """Ids of words without white space: those of their letters, then those of their punctuation or of the whole word."""
        cores = pc.utf8_rtrim(words, _MARKS)
        lower = pc.utf8_lower(pc.if_else(pc.match_substring_regex(cores, f"^{_LETTERS}$"), cores, ""))
        rest = pc.replace_substring_regex(words, f"^{_LETTERS}([{_MARKS}]*)$", r"\1")
        found = []
        for kept, strings, make in ((self.parts, lower, self.many), (self.words, rest, self.whole)):
            coded = strings.dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            new = kept.lacking(distinct)
            kept.update(zip(new, make(new), strict=True))
            found.append(pa.array([kept[w] for w in distinct], pa.large_binary()).take(coded.indices))
        return pc.binary_join_element_wise(*found, pa.scalar(b"", pa.large_binary()))


@in_worker
def tokens(path: str, kept: int = KEPT) -> Tokens:
    return Tokens(path, kept)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0, kept: int = KEPT, together: int = 1 << 21) -> DataFrame:
    """The ids of every text of ``docs`` (doc_id, text) and the ``end`` id, cut every ``capacity`` ids.

    ``kept`` words stay in a worker's table, and texts of about ``together`` bytes are cut at once: less of both takes less memory
    and more time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = tokens(path, kept)
        last = np.array([end], "<u4").tobytes()
        for batch in slices(batches):
            for a, b in groups([t.as_buffer() for t in batch.column(1)], together):
                rows, number, ids = [], [], []
                for i, found in enumerate(one.of_each(batch.column(1).slice(a, b - a)), a):
                    found += last
                    for piece, at in enumerate(range(0, len(found), 4 * capacity)):
                        rows.append(i)
                        number.append(piece)
                        ids.append(found[at : at + 4 * capacity])
                n = np.array(number, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(n, pa.int32()), pa.array(n * capacity), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )
        one.forget()

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, PIECES)


def priced(lengths: np.ndarray, values: np.ndarray, capacity: int) -> list[int]:
    """The knapsack table: for every room, the index of ``lengths`` (ascending) that the pattern of greatest value takes there, or -1."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(int(lengths[0]), capacity + 1):
        k = upto[room]
        gain = best[room - lengths[:k]] + values[:k]
        i = int(gain.argmax())
        if gain[i] > best[room - 1]:
            best[room], pick[room] = gain[i], i
        else:
            best[room] = best[room - 1]
    return pick.tolist()


def filled(room: int, pick: list[int], lengths: list[int]) -> dict[int, int]:
    """The pattern of greatest value for ``room``: how often each index is taken."""
    out: dict[int, int] = {}
    while room > 0:
        i = pick[room]
        if i < 0:
            room -= 1
        else:
            out[i] = out.get(i, 0) + 1
            room -= lengths[i]
    return out


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, share: float = SHARE, rate: float = RATE) -> list[tuple[dict[int, int], float]]:
    """Patterns and how often each is used, by multiplicative weights over the lengths, until every length is covered.

    A length is worth the room it takes, raised by a weight that shrinks exponentially as the length is covered. One
    knapsack table a round prices the best pattern around every length; the lengths covered least use theirs for a
    ``share`` of their pieces (one piece at least). Patterns that need more of a length than is left wait for the next prices.
    """
    left = counts.astype(float)
    found: dict[tuple, float] = {}
    goal = 0.0
    while True:  # a round uses up a length, or a share of one
        open_ = np.flatnonzero(left >= 1)
        if not len(open_):
            break
        covered = 1 - left[open_] / counts[open_]
        goal = max(goal, covered.min()) + share
        pick = priced(lengths[open_], lengths[open_] * (1 + NUDGE * np.exp(-rate * covered)), capacity)
        own, at = lengths[open_].tolist(), open_.tolist()

        def use(pattern: dict[int, int], k: int, at: list[int] = at) -> None:
            step = min(max(1.0, share * counts[at[k]] / pattern[k]), *(left[at[j]] / n for j, n in pattern.items()))
            for j, n in pattern.items():
                left[at[j]] -= step * n
            key = tuple(sorted((at[j], n) for j, n in pattern.items()))
            found[key] = found.get(key, 0) + step

        short = None
        waits = True
        for k in reversed(np.flatnonzero(covered < goal).tolist()):
            if left[at[k]] < 1 or 1 - left[at[k]] / counts[at[k]] >= goal:
                continue
            pattern = filled(capacity - own[k], pick, own)
            pattern[k] = pattern.get(k, 0) + 1
            if all(left[at[j]] >= n for j, n in pattern.items()):
                use(pattern, k)
                waits = False
            elif short is None:
                short = pattern, k
        if waits and short:  # no pattern can be had whole
            pattern, k = short
            use({j: min(n, math.floor(left[at[j]])) for j, n in pattern.items() if left[at[j]] >= 1}, k)
    return [(dict(p), x) for p, x in found.items()]


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over counts of lengths: patterns and how many sequences have each.

    Sequences with the same content are one entry, so the work depends on the lengths, not on the counts.
    """
    rooms: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    some = np.zeros(capacity + 1, bool)

    def put(pattern: tuple[int, ...], times: int, room: int) -> None:
        rooms[room].append((pattern, times))
        some[room] = True

    for n, c in sorted(counts.items(), reverse=True):
        while c > 0:
            room = n + int(some[n:].argmax())
            if not some[room]:
                each = capacity // n
                if c >= each:
                    put((n,) * each, c // each, capacity - n * each)
                if c % each:
                    put((n,) * (c % each), 1, capacity - n * (c % each))
                break
            pattern, times = rooms[room].pop()
            k = min(c, times)
            if times > k:
                rooms[room].append((pattern, times - k))
            some[room] = bool(rooms[room])
            put((*pattern, n), k, room - n)
            c -= k
    return [x for group in rooms for x in group]


def rounded(counts: dict[int, int], capacity: int, waste: int) -> tuple[list[tuple[list[int], int]], dict[int, int]]:
    """Whole numbers of patterns, and the counts that they leave.

    The fractional solution is rounded down, and the program solved again for what that leaves, as long as this places a
    tenth of it. Patterns that leave more room than ``waste`` are not used.
    """
    left, out = dict(counts), []
    while left:
        lengths, before = sorted(left), sum(left.values())
        for pattern, times in fractional(np.array(lengths, np.int64), np.array([left[n] for n in lengths]), capacity):
            room = capacity - sum(lengths[i] * n for i, n in pattern.items())
            k = min(math.floor(times + 1e-9), *(left[lengths[i]] // n for i, n in pattern.items()))
            if k > 0 and room <= waste:
                out.append(([lengths[i] for i, n in sorted(pattern.items(), reverse=True) for _ in range(n)], k))
                for i, n in pattern.items():
                    left[lengths[i]] -= k * n
        left = {n: c for n, c in left.items() if c}
        if 10 * (before - sum(left.values())) < before:
            break
    return out, left


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, first rank, number of ranks, first sequence, offset), and the number of sequences."""
    counts = {n: c for n, c in counts.items() if c > 0}
    if not counts:
        return [], 0
    bound = -(-sum(n * c for n, c in counts.items()) // capacity)
    whole: list[list[tuple[list[int], int]]] = []
    for waste in (*WASTES, None):
        out, left = ([], counts) if waste is None else rounded(counts, capacity, round(capacity * waste))
        whole.append(out + [(list(pattern), times) for pattern, times in best_fit(left, capacity)])
        if sum(k for _, k in whole[-1]) <= bound * (1 + WASTES[0]):
            break
    rank = dict.fromkeys(counts, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    for pattern, times in min(whole, key=lambda found: sum(k for _, k in found)):
        offset = 0
        for n in pattern:
            rows.append((n, rank[n], times, sequences, offset))
            rank[n] += times
            offset += n
        sequences += times
    return rows, sequences


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (doc_id, piece, start, length and more) with sequence_id and offset.

    Read twice, for the histogram and for the numbering: give a table or a checkpoint.
    """
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    rows, _ = plan(counts, capacity)
    rows.sort()
    keys = np.array([n * (1 << 44) + first for n, first, _, _, _ in rows], np.int64)
    firsts, sequences, offsets = (np.array([r[i] for r in rows], np.int64) for i in (1, 3, 4))
    slices = {n: -(-c // SLICE) for n, c in counts.items()}
    number = np.ones(capacity + 1, np.int64)
    number[list(slices)] = list(slices.values())

    @F.arrow_udf("int")
    def slices_of(lengths: pa.Array) -> pa.Array:
        return pa.array(number[lengths.to_numpy()], pa.int32())

    # else the join's test for missing keys is pushed below the shuffle, where it calls this again in Python workers of its own
    slices_of = slices_of.asNondeterministic()

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        n, rank = lengths.to_numpy(), ranks.to_numpy()
        k = np.searchsorted(keys, n * (1 << 44) + rank, "right") - 1
        return pa.StructArray.from_arrays([pa.array(sequences[k] + rank - firsts[k]), pa.array(offsets[k])], names=["sequence_id", "offset"])

    salted = found.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), slices_of("length")).cast("int"))
    # at most count / SLICE slices for a length
    sizes = salted.groupBy("length", "slice").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("length").orderBy("slice")) - F.col("size")
    bases = sizes.select("length", "slice", before.alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "slice").orderBy(*(c for c in found.columns if c != "length")))
    ranked = salted.withColumn("within", within - 1).join(bases, ["length", "slice"])
    placed = ranked.withColumn("place", place("length", F.col("base") + F.col("within")))
    return placed.select(*found.columns, "place.sequence_id", "place.offset")


def checksums(found: DataFrame) -> DataFrame:
    """pieces() with the CRC-32 of the ids in place of the ids."""
    return found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
