"""Removal of repeated word windows by recompression.

Every text is a sequence of word names. Rounds shorten it: one round names maximal runs of a word,
the others split all symbols into left and right ones by a bit of their names and name every adjacent
left-right pair. A name follows from its parts alone, so all tasks name equal parts alike and equal
passages get equal symbols in their interior. For each symbol the context is kept that decided it:
the words such that any other passage with the same words has the same symbol there. A window of
``width`` words thus shares every symbol whose context it holds with all its copies.

1. Symbols whose context fits a window are shuffled by name; those found twice or more are shared.
   A window that holds no symbol's context (a long run, say) stands for itself.
2. Windows all of whose symbols are shared are verified: they are named by 96 bits over all their
   words, shuffled by name, and all but the first copy count as repeats.
3. The words under repeats are dropped.

Before either shuffle a task keeps one row for equal names of its batch and marks the others itself,
so that a passage in a third of all texts sends a few rows from each task. Sequences are never
gathered: the largest unit in memory is a batch of whole texts.

Result: one row for each input row. Texts are ordered by doc_id (NULL first), then by text; rows with
the same doc_id and text are one document and get the same result. A NULL or empty text has no words
and stays empty; a text of fewer than ``width`` words is kept. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.kept import give_up
from tidewell.llm.words import STEPS, groups, mix, name_texts, places, powers, slices, spans, window_names

WIDTH = 20
#: Rounds of pairing, and the most words a symbol may have.
ROUNDS, LONGEST = 3, 12
NONE = np.uint64((1 << 64) - 1)
#: `at` is a place in a text, with the number of the text among those of its id above COPY.
FOUND = "name long, more int, id long, at long, run int"
COPY = 1 << 32
#: Texts of a batch taken together: equal names among them are sent once.
TOGETHER = 6144
#: Stands for a NULL doc_id in keys and order, and so is read as NULL.
NO_ID = -(1 << 63)


@lru_cache(maxsize=8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(STEPS[1], n), powers(pow(STEPS[1], -1, 1 << 64), n)


def step_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a step and of its inverse, at least ``n`` of each."""
    return _powers(1 << max(10, (n - 1).bit_length()))


def recompress(names: np.ndarray, text: np.ndarray, rounds: int = ROUNDS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of texts laid end to end: name, and first word and end of the context that decided it.

    ``text`` numbers the texts. A context that reaches past the end of its text holds the word beyond it.
    """
    n = len(names)
    if not n:
        none = np.zeros(0, np.int64)
        return names, none, none
    new = np.ones(n, bool)
    new[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    end = np.append(first[1:], n)
    size = end - first
    name = mix(names[first] + size.astype(np.uint64) * np.uint64(STEPS[0]))
    low, high, doc = first - 1, end + 1, text[first]
    for k in range(rounds):
        bit = mix(name ^ np.uint64(k + 1)) >> np.uint64(63)
        follows = doc[1:] == doc[:-1]
        short = size < longest
        left, right = short & (bit == 0), short & (bit == 1)
        pair = np.zeros(len(name), bool)  # a left symbol and the right one after it
        pair[:-1] = left[:-1] & right[1:] & follows & (size[:-1] + size[1:] <= longest)
        l2, h2 = low.copy(), high.copy()
        see = left.copy()  # depends on the symbol after it
        see[-1] = False
        see[:-1] &= follows
        i = np.flatnonzero(see)
        l2[i], h2[i] = np.minimum(l2[i], low[i + 1]), np.maximum(h2[i], high[i + 1])
        see = right.copy()  # depends on the symbol before it
        see[0] = False
        see[1:] &= follows
        i = np.flatnonzero(see)
        l2[i], h2[i] = np.minimum(l2[i], low[i - 1]), np.maximum(h2[i], high[i - 1])
        # at either end of a text the contexts already reach past it
        i = np.flatnonzero(pair)
        name = name.copy()
        name[i] = mix(name[i] * np.uint64(STEPS[0]) + mix(name[i + 1] + np.uint64(k)))
        l2[i], h2[i] = np.minimum(l2[i], l2[i + 1]), np.maximum(h2[i], h2[i + 1])
        size = size.copy()
        size[i] += size[i + 1]
        keep = np.ones(len(name), bool)
        keep[i + 1] = False
        name, low, high, size, doc = name[keep], l2[keep], h2[keep], size[keep], doc[keep]
    return name, low, high


def anchors(names: np.ndarray, counts: np.ndarray, width: int, rounds: int = ROUNDS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which symbol stands for each window of texts laid end to end.

    Of the symbols whose context a window holds, the leftmost of those whose context has the smallest
    name; a window without a symbol stands for itself. Equal windows thus have equal symbols at the same
    distance. Returns the names of these symbols in order, their texts, and for each window's first word
    the number of its symbol; -1 where no window starts.
    """
    n = len(names)
    text, _ = places(counts)
    stands = np.full(n, -1, np.int64)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), stands
    starts = np.zeros(n, bool)
    starts[: n - width + 1] = text[: n - width + 1] == text[width - 1 :]
    _, low, high = recompress(names, text, rounds, longest)
    fits = np.flatnonzero((high - low <= width) & (low >= 0) & (high <= n))
    low, high = low[fits], high[fits]
    fits = text[low] == text[high - 1]
    low, high = low[fits], high[fits]
    total = np.zeros(n + 1, np.uint64)
    up, down = step_powers(n + 1)
    np.cumsum(names * up[:n], out=total[1:])
    key = mix((total[high] - total[low]) * down[low] + (high - low).astype(np.uint64))
    slack = width - (high - low)
    least = np.full(n, NONE, np.uint64)
    steps = []
    for d in range(int(slack.max()) + 1 if len(slack) else 0):
        i = np.flatnonzero((slack >= d) & (low >= d))
        steps.append(i)
        np.minimum.at(least, low[i] - d, key[i])
    place = np.full(n, -1, np.int64)
    for d in range(len(steps) - 1, -1, -1):
        i = steps[d]
        i = i[least[low[i] - d] == key[i]]
        place[low[i] - d] = low[i]
    alone = np.flatnonzero(starts & (place < 0))
    least[alone] = window_names(names, width, STEPS[1])[alone]
    place[alone] = n + alone
    at = np.flatnonzero(starts)
    new = np.ones(len(at), bool)
    new[1:] = place[at[1:]] != place[at[:-1]]
    stands[at] = np.cumsum(new) - 1
    return least[at[new]], text[at[new]], stands


def identified(docs: DataFrame) -> DataFrame:
    """(id, text, copy, again): ``copy`` numbers the texts of one id, ``again`` marks a row seen before.

    All that follows needs these columns and no other, so that Spark shuffles the texts once.
    """
    text = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    by_id = Window.partitionBy("id").orderBy("text")
    return text.select(
        "*", F.dense_rank().over(by_id).cast("long").alias("copy"), F.lag("text").over(by_id).eqNullSafe(F.col("text")).alias("again")
    )


def first_of_equals(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries in order: which are the first with their keys, and which have keys that occur twice or more."""
    n = len(keys[0])
    order = np.lexsort((*keys[1:], keys[0]))  # stable, so equal entries stay in order
    same = np.zeros(n, bool)
    same[1:] = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
    first, twice = np.zeros(n, bool), np.zeros(n, bool)
    first[order[~same]] = True
    twice[order[same]] = True
    twice[order[:-1][same[1:]]] = True
    return first, twice


def encoded(batch: pa.RecordBatch) -> list[bytes]:
    """The texts as UTF-8."""
    return [t.as_buffer().to_pybytes() for t in batch.column("text")]


def emitted(batch: pa.RecordBatch, rows: np.ndarray, name: np.ndarray, more: np.ndarray, at: np.ndarray, run: np.ndarray) -> pa.RecordBatch:
    ids, copies = (batch.column(c).to_numpy()[rows] for c in ("id", "copy"))
    return pa.RecordBatch.from_arrays(
        [pa.array(name.view(np.int64)), pa.array(more, pa.int32()), pa.array(ids), pa.array(copies * COPY + at), pa.array(run, pa.int32())],
        names=["name", "more", "id", "at", "run"],
    )


def of_copy(lists: pa.Array, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From lists of `at`, the entries of each row's own text: their rows, places and positions in the flat list."""
    rows = np.repeat(np.arange(len(copies)), np.diff(lists.offsets.to_numpy()))
    flat = lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
    mine = np.flatnonzero(flat // COPY == copies[rows])
    return rows[mine], flat[mine] % COPY, mine


def symbols(docs: DataFrame, width: int) -> DataFrame:
    """The symbols of all texts. run 0: to be compared by name; 1: known to be shared; 2: known, others need not see it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        for batch in slices(batches, TOGETHER):
            texts = encoded(batch)
            names, rows, at = [], [], []
            for a, b in groups(texts):
                words, counts = name_texts(texts[a:b])
                name, text, _ = anchors(words, counts, width)
                size = np.bincount(text, minlength=b - a)
                names.append(name)
                rows.append(text + a)
                at.append(places(size)[1])
            if not names:
                continue
            name, row, place = map(np.concatenate, (names, rows, at))
            first, twice = first_of_equals(name)
            # a known symbol needs a name only so that others learn of it
            name[~first] = mix(name[~first] + np.flatnonzero(~first).astype(np.uint64) * np.uint64(STEPS[1]))
            yield emitted(batch, row, name, np.zeros(len(name)), place, np.where(first, twice.astype(np.int64), 2))

    return docs.select("id", "copy", "text").mapInArrow(run, FOUND)


def shared_symbols(found: DataFrame) -> DataFrame:
    """For each id, the numbers of the symbols of its texts that occur elsewhere too."""
    by_name = Window.partitionBy("name").orderBy("id", "at")
    seen = found.withColumn("before", F.lag(F.lit(1)).over(by_name)).withColumn("after", F.lead(F.lit(1)).over(by_name))
    shared = seen.filter((F.col("run") > 0) | F.col("before").isNotNull() | F.col("after").isNotNull())
    return shared.groupBy("id").agg(F.collect_list("at").alias("shared"))


def windows(texts: DataFrame, width: int) -> DataFrame:
    """Windows whose symbol is shared. run 0: to be compared by name; else so many windows known to be repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TOGETHER):
            batch = batch.take(pa.compute.sort_indices(batch, sort_keys=[("id", "ascending"), ("copy", "ascending")]))
            texts = encoded(batch)
            owners, numbers, _ = of_copy(batch.column("shared"), batch.column("copy").to_numpy())
            names, mores, rows, at = [], [], [], []
            for a, b in groups(texts):
                words, counts = name_texts(texts[a:b])
                name, text, stands = anchors(words, counts, width)
                size = np.bincount(text, minlength=b - a)
                base = np.cumsum(size) - size
                shared = np.zeros(len(name) + 1, bool)  # the last for windows that do not start
                mine = slice(*np.searchsorted(owners, [a, b]))
                shared[base[owners[mine] - a] + numbers[mine]] = True
                place = np.flatnonzero(shared[stands])
                owner, within = places(counts)
                names.append(window_names(words, width, STEPS[0])[place])
                mores.append((window_names(words, width, STEPS[1])[place] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                rows.append(owner[place] + a)
                at.append(within[place])
            if not names:
                continue
            name, more, row, place = map(np.concatenate, (names, mores, rows, at))
            first, _ = first_of_equals(name, more)
            # the others are repeats: one row for windows side by side
            other = np.flatnonzero(~first)
            head = np.ones(len(other), bool)
            head[1:] = (row[other][1:] != row[other][:-1]) | (place[other][1:] != place[other][:-1] + 1)
            runs = np.diff(np.append(np.flatnonzero(head), len(other)))
            heads = other[head]
            keep = np.concatenate([np.flatnonzero(first), heads])
            name[heads] = mix(name[heads] + heads.astype(np.uint64) * np.uint64(STEPS[1]))
            yield emitted(batch, row[keep], name[keep], more[keep], place[keep], np.concatenate([np.zeros(int(first.sum()), np.int64), runs]))

    return texts.select("id", "copy", "text", "shared").mapInArrow(run, FOUND)


def repeats(found: DataFrame) -> DataFrame:
    """For each id, the first words and numbers of the windows of its texts that also start earlier."""
    earlier = F.row_number().over(Window.partitionBy("name", "more").orderBy("id", "at"))
    later = found.withColumn("earlier", earlier).filter((F.col("run") > 0) | (F.col("earlier") > 1))
    run = F.greatest("run", F.lit(1)).alias("run")
    return later.groupBy("id").agg(F.collect_list(F.struct("at", run)).alias("repeats"))


_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def cut(text: bytes, gone: np.ndarray) -> bytes:
    """``text`` without the words marked in ``gone``, each with the white space behind it; the rest stays byte for byte."""
    starts = np.array([m.start() for m in _WORD.finditer(text)] + [len(text)])
    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    at, out = 0, []
    for first, after in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        out.append(text[at : starts[first]])
        at = starts[after]
    return b"".join([*out, text[at:]])


def without_repeats(texts: DataFrame, width: int, joined: bool = True) -> DataFrame:
    """Words and removed words of each text, and what stays of it: its words joined by one space, or the text with the others cut out."""
    lists = (F.coalesce(F.col(f"repeats.{c}"), F.array().cast(kind)).alias(c) for c, kind in (("at", "array<long>"), ("run", "array<int>")))
    doc_id = F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id")
    given = texts.select(doc_id, F.xxhash64("text").alias("text_name"), "copy", "text", *lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            total, removed, kept = [], [], []
            rows, place, mine = of_copy(batch.column("at"), batch.column("copy").to_numpy())
            stop = place + batch.column("run").flatten().to_numpy()[mine] - 1 + width
            for i, text in enumerate(encoded(batch)):
                words = text.split()
                total.append(len(words))
                of_text = slice(*np.searchsorted(rows, [i, i + 1]))
                if of_text.start < of_text.stop:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, place[of_text], 1)
                    np.add.at(edge, stop[of_text], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    words = [words[k] for k in np.flatnonzero(~gone).tolist()]
                    text = text if joined else cut(text, gone)
                removed.append(total[-1] - len(words))
                kept.append((b" ".join(words) if joined else text).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_name"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "text_name", "n_words", "n_removed", "kept"],
            )

    return given.mapInArrow(run, "doc_id long, text_name long, n_words long, n_removed long, kept string")


def dedup(docs: DataFrame, width: int = WIDTH, joined: bool = True) -> DataFrame:
    """doc_id, text_name, n_words, n_removed and kept text of every row of ``docs`` (doc_id, text).

    ``kept`` is the words that stay, joined by one space, or, without ``joined``, the text with the removed words cut out.

    All joins are on the id by which the texts were shuffled, so the texts move once.
    """
    texts = identified(docs)
    once = texts.filter(~F.col("again"))
    shared = shared_symbols(symbols(once, width))
    found = repeats(windows(once.join(shared, "id"), width))
    return without_repeats(texts.join(found, "id", "left"), width, joined)


def cleaned(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with the repeated words cut out of the texts, and n_chars, if there, to match. No row goes.

    Texts without repeats, and what stays of the others, keep their line breaks and white space; NULL stays NULL.
    """
    found = dedup(docs, width, joined=False).select(F.col("doc_id").alias("id__"), F.col("text_name").alias("name__"), F.col("kept").alias("kept__"))
    number = F.row_number()  # rows of one doc_id and text are alike in ``found``
    found = found.withColumn("number__", number.over(Window.partitionBy("id__", "name__").orderBy("id__")))
    own = [F.xxhash64(F.coalesce("text", F.lit(""))).alias("own_name__"), F.col("text").isNull().alias("none__")]
    others = docs.select(*(c for c in docs.columns if c != "text"), *own)
    others = others.withColumn("own_number__", number.over(Window.partitionBy("doc_id", "own_name__").orderBy("own_name__")))
    on = (others["own_name__"] == found["name__"]) & others["doc_id"].eqNullSafe(found["id__"]) & (others["own_number__"] == found["number__"])
    text = F.when(~F.col("none__"), F.col("kept__"))
    columns = {"text": text.alias("text"), "n_chars": F.length(text).cast("long").alias("n_chars")}
    return others.join(found, on).select(*(columns.get(c, F.col(c)) for c in docs.columns))
