"""Benchmark decontamination: passages of benchmark items found in documents, by an FM-index of each shard.

Words are runs of ASCII letters, digits and bytes beyond ASCII, A-Z as a-z. A window is ``WIDTH`` consecutive words of an item; an
item with fewer is one window. A shard is a run of documents of bounded size. In it, words that no window holds are
separators, and so are the ends of documents; stretches between separators that are shorter than every window hold none and
are left out. The shard's FM-index searches all windows backward through wavelet ranks, locates the occurrences by sampled suffix
positions, and the words they cover are merged to spans to be removed.

The windows of the benchmark reach the tasks in blocks of about ``WINDOWS`` (window, item) rows; beyond one block, the documents pass
once for each block and spans and items are merged on the way. Nothing of a document is shuffled.

Result: one row for each document, repeated rows included. NULL and empty texts have no words. Items with the same id count
once, and NULL as the id ''. An item without words occurs nowhere. Words are compared by 64-bit names. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.fm_index import FMIndex
from tidewell.llm.stored import stored_table
from tidewell.llm.words import groups, slices, spans

WIDTH = 10
#: (window, item) rows in a block, at most about 100 bytes each.
WINDOWS = 200_000
#: Bytes of texts in a shard (or one longer text), and words in one index.
SHARD, INDEXED = 1 << 23, 1 << 21

#: Letters and digits stay, A-Z become a-z, every other ASCII byte is white space.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def encoded(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    return [t.as_buffer().to_pybytes().translate(_WORD_BYTES) if t.is_valid else b"" for t in batch.column(column)]


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, first bytes and ends in its text of every word, and the number of words of each text."""
    names, start, end = spans(b"\n".join(texts))
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    counts = np.diff(np.searchsorted(start, at))
    offset = np.repeat(at[:-1], counts)
    return names, start - offset, end - offset, counts


def windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(item_id, window) of all items; a window is its words' names, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, ids = encoded(batch), batch.column("item_id").to_pylist()
            names, _, _, counts = words_of(texts)
            found, at = [], 0
            for item, n in zip(ids, counts.tolist(), strict=True):
                raw = names[at : at + n].tobytes()
                found += [(item, raw[8 * i : 8 * (i + min(n, width))]) for i in range(max(n - width, 0) + 1) if n]
                at += n
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.string()), pa.array([w for _, w in found], pa.binary())], names=["item_id", "window"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return items.mapInArrow(run, "item_id string, window binary").distinct()


class Block:
    """Distinct windows of a block as rows of word numbers, and the items of each."""

    def __init__(self, item_ids: list[str], raw: list[bytes]):
        self.items = sorted(set(item_ids))
        number = {item: i for i, item in enumerate(self.items)}
        distinct = sorted(set(raw), key=lambda w: (len(w), w))
        row = {w: i for i, w in enumerate(distinct)}
        held: list[set[int]] = [set() for _ in distinct]
        for i, w in zip(item_ids, raw, strict=True):
            held[row[w]].add(number[i])
        #: Windows with the same items share a set; ``members`` lists each set once.
        sets: dict[tuple[int, ...], int] = {}
        self.set_of = np.array([sets.setdefault(tuple(sorted(h)), len(sets)) for h in held], np.int64)
        self.members = [np.array(s, np.int64) for s in sets]
        self.sizes = np.array([len(w) // 8 for w in distinct], np.int64)
        flat = np.frombuffer(b"".join(distinct), np.uint64)
        self.vocabulary = np.unique(flat)
        self.patterns = np.zeros((len(distinct), int(self.sizes.max(initial=0))), np.int64)
        self.patterns[np.arange(self.patterns.shape[1]) < self.sizes[:, None]] = np.searchsorted(self.vocabulary, flat) + 1
        #: Low bits of the names, to leave most other words aside.
        self.mask = np.uint64((1 << max(16, (4 * len(self.vocabulary)).bit_length())) - 1)
        self.low = np.zeros(int(self.mask) + 1, bool)
        self.low[(self.vocabulary & self.mask).astype(np.int64)] = True

    def numbers(self, names: np.ndarray) -> np.ndarray:
        """The words' places in the vocabulary from 1 on, 0 for all others."""
        out = np.zeros(len(names), np.int64)
        some = np.flatnonzero(self.low[(names & self.mask).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, names[some]), len(self.vocabulary) - 1)
        same = self.vocabulary[at] == names[some]
        out[some[same]] = at[same] + 1
        return out

    def occurrences(self, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and window of every occurrence in texts whose words have these numbers; some may come twice."""
        none = np.zeros(0, np.int64)
        if not len(self.sizes) or not len(numbers):
            return none, none
        ends = np.zeros(len(numbers) + 1, bool)
        ends[np.cumsum(counts)] = ends[0] = True
        word = np.flatnonzero(numbers)
        start = word[(numbers[word - 1] == 0) | ends[word]]
        stop = word[np.concatenate([numbers[1:] == 0, [True]])[word] | ends[word + 1]] + 1
        least, most = int(self.sizes.min()), int(self.sizes.max())
        long = stop - start >= least
        found: list[tuple[np.ndarray, np.ndarray]] = [(none, none)]
        part, size = [], 0
        for s, e in zip(start[long].tolist(), stop[long].tolist(), strict=True):
            for at in range(s, max(e - most, s) + 1, INDEXED):  # longer stretches overlap by a window less one
                to = min(at + INDEXED + most - 1, e)
                if size and size + to - at > INDEXED:
                    found.append(self.in_stretches(numbers, part))
                    part, size = [], 0
                part.append((at, to))
                size += to - at + 1
        if part:
            found.append(self.in_stretches(numbers, part))
        place, window = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        return place, window

    def in_stretches(self, numbers: np.ndarray, part: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences in some stretches of words, by one index over them."""
        at, to = (np.array(x, np.int64) for x in zip(*part, strict=True))
        first = np.cumsum(to - at + 1) - (to - at)  # a separator stands before each stretch
        sequence = np.zeros(int((to - at + 1).sum()) + 1, np.int64)
        inner = np.arange(int((to - at).sum())) + np.repeat(np.arange(1, len(at) + 1), to - at)
        sequence[inner] = numbers[inner + np.repeat(at - first, to - at)]
        index = FMIndex(sequence, len(self.vocabulary))
        low, high = index.search(self.patterns, self.sizes)
        many = np.maximum(high - low, 0)
        window = np.repeat(np.arange(len(many)), many)
        rows = np.arange(len(window)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        found = index.locate(rows)
        stretch = np.searchsorted(first, found, "right") - 1
        return found - first[stretch] + at[stretch], window

    def sets(self, doc: np.ndarray, window: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Each text with occurrences, and the items they belong to."""
        some = max(len(self.members), 1)
        found = np.unique(doc * some + self.set_of[window])
        cuts = np.flatnonzero(np.diff(found // some)) + 1
        for part in np.split(found, cuts) if len(found) else ():
            yield int(part[0] // some), np.unique(np.concatenate([self.members[k] for k in (part % some).tolist()])).tolist()


def merged(place: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Which of n words are covered by spans."""
    edge = np.bincount(place, minlength=n + 1) - np.bincount(place + size, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


_KEPT = "doc_id long, text string, n_words long, spans array<struct<first: int, after: int, from_byte: int, to_byte: int>>, items array<string>"


def search(docs: DataFrame, block) -> DataFrame:
    """``docs`` with the spans and items of one block (a broadcast Block) merged into its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one: Block = block.value
        for batch in slices(batches, 4096):
            texts = encoded(batch)
            for a, b in groups(texts, SHARD):
                rows = batch.slice(a, b - a)
                names, start, end, counts = words_of(texts[a:b])
                first = np.concatenate([[0], np.cumsum(counts)])
                place, window = one.occurrences(one.numbers(names), counts)
                size = one.sizes[window]
                doc = np.searchsorted(first, place, "right") - 1
                items: list[list[str]] = rows.column("items").to_pylist()
                for d, sets in one.sets(doc, window):
                    items[d] += [one.items[i] for i in sets]
                before = rows.column("spans").to_pylist()
                old = [(first[d] + s["first"], s["after"] - s["first"]) for d, known in enumerate(before) for s in known]
                hit = merged(np.concatenate([place, np.array([p for p, _ in old], np.int64)]), np.concatenate([size, np.array([n for _, n in old], np.int64)]), len(names))
                edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
                lists: list[list[dict]] = [[] for _ in range(b - a)]
                for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # spans of neighbours in the array are cut at their texts' ends
                    while s < e:
                        d = int(np.searchsorted(first, s, "right")) - 1
                        to = min(e, int(first[d + 1]))
                        lists[d].append({"first": s - int(first[d]), "after": to - int(first[d]), "from_byte": int(start[s]), "to_byte": int(end[to - 1])})
                        s = to
                kind = rows.schema.field("spans").type
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("text"), pa.array(counts, pa.int64()), pa.array(lists, kind), pa.array(items, pa.list_(pa.string()))],
                    names=["doc_id", "text", "n_words", "spans", "items"],
                )

    return docs.mapInArrow(run, _KEPT)


def contaminations(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text, n_words, n_hit, spans (words and bytes, merged, ascending) and items (their ids, ascending) of every document."""
    spark = docs.sparkSession
    pairs = stored_table(windows(benchmark, width))
    blocks = max(1, -(-pairs.count() // WINDOWS))
    kind = "array<struct<first: int, after: int, from_byte: int, to_byte: int>>"
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("n_words"), F.array().cast(kind).alias("spans"), F.array().cast("array<string>").alias("items"))
    number = F.pmod(F.xxhash64("item_id", "window"), F.lit(blocks))
    for k in range(blocks):
        rows = pairs.filter(number == k).toArrow()
        one = Block(rows.column("item_id").to_pylist(), rows.column("window").to_pylist())
        found = search(found, spark.sparkContext.broadcast(one))
        if k < blocks - 1:
            found = stored_table(found)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["after"] - s["first"])
    return found.select("doc_id", "text", "n_words", n_hit.alias("n_hit"), "spans", F.array_sort(F.array_distinct("items")).alias("items"))


def cleaned(found: DataFrame) -> DataFrame:
    """The rows of contaminations() with the spans taken out of their texts, byte for byte; other texts stay as they are."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans_: pa.Array) -> pa.Array:
        out = []
        for text, places in zip(texts.cast(pa.binary()).to_pylist(), spans_.to_pylist(), strict=True):
            edges = [0, *(x for s in places for x in (s["from_byte"], s["to_byte"])), len(text)]
            out.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode())
        return pa.array(out, pa.string())

    return found.withColumn("text", F.when(F.col("n_hit") > 0, cut(F.coalesce("text", F.lit("")), "spans")).otherwise(F.col("text")))


def report(found: DataFrame) -> DataFrame:
    """Words hit and items of each row of contaminations()."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
