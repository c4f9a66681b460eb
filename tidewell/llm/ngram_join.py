"""Near copies by exact Jaccard similarity of word n-grams, with prefix filters under several orders.

A set of n tokens that links with another (similarity of ``percent`` or more) shares one of its first
n - ceil(n * percent / 100) + 1 tokens with it under any global order of tokens, and the first shared
token stands early enough in both that the rest can still suffice (position filter). Three orders are
used, each with the tokens that many texts hold at the end:

1. One pass names every text's set, counts the tokens that recur within a batch, and keeps the most
   frequent ones (a table of bounded size; it decides how well the filters work, never the result).
2. Texts with equal sets are one class. Classes meet in a shuffle on their prefix tokens under the
   first order, which leaves classes that share one.
3. Per token and size range, each class is compared with one hub, the class with the fewest rare tokens. A pair whose parity
   signatures (a lower bound of the difference) are near enough gets its whole sets, and must share a prefix token
   under the second and third order too before these are compared. Verified links give components.
4. Pairs of classes of different components are looked for inside tasks (``pairing``): size, position and signature are tested there, and
   only what passes is sent on to verification. In the first rounds a row sends its best partners alone, so that a group of
   near copies grows together by as many pairs as it has members; the last round sends all that pass and are not in one
   component yet. So no link between different components is missed.

Result: one row for each input row. A NULL text or one without words has an empty set and links with
nothing; fewer words than ``width`` are one token. Rows are linked by text, whatever their doc_id, and
component_id is the smallest doc_id of the component (NULL only if all are NULL). Other columns are not
looked at. Sets and tokens are compared by 64-bit names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.components import components
from tidewell.llm.kept import give_up
from tidewell.llm.pairing import as_pairs, hot_tokens, pairs_in_tasks
from tidewell.llm.stored import stored, stored_table
from tidewell.llm.words import STEPS, groups, mix, name_texts, slices, window_names

WIDTH, PERCENT = 5, 80
#: Most frequent tokens that are put last; at 8 bytes each this bounds what is sent to every task.
FREQUENT = 1 << 18
#: A token counts as recurring in a batch from this many texts on, and this share of its texts.
RECURS, RECURS_SHARE = 4, 0.001
#: Best partners that a class sends for each token, and rounds of it at most before all are sent.
BEST, ROUNDS = 1, 4
#: Bytes of the folded signatures that travel with the rows of a token: in the first round, and with the fewer rows of later ones.
SMALL_SIGNATURE, MIDDLE_SIGNATURE = 64, 512
#: Needed ids up to this number are broadcast (16 MB); beyond, Spark joins by shuffle.
SMALL = 1_000_000

#: Columns of the rows that meet.
MET = "token long, class long, n int, i int, rare int"

_LENGTH = np.uint64(0x2545F4914F6CDD1D)
_CLASS = np.uint64(0x9E6C63D0876A9A47)


def token_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The distinct tokens of each text, ascending by name."""
    for a, b in groups(texts):
        words, counts = name_texts(texts[a:b], lower=True)
        all_of = window_names(words, width, STEPS[0])
        at = 0
        for n in counts.tolist():
            if n >= width:
                yield np.unique(all_of[at : at + n - width + 1])
            elif n:
                yield mix(window_names(words[at : at + n], n, STEPS[0])[:1] + np.uint64(n) * _LENGTH)
            else:
                yield np.zeros(0, np.uint64)
            at += n


def class_name(tokens: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(mix(np.array([mix(tokens ^ _CLASS).sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


class Orders:
    """Global orders of tokens: by how often they recur, then by a different hash in each order."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray):
        order = np.argsort(frequent)
        self.frequent, self.counts = frequent[order], counts[order]

    def recurs(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.frequent, tokens), len(self.frequent) - 1)
        return np.where(self.frequent[at] == tokens, self.counts[at], 0)

    def prefix(self, tokens: np.ndarray, size: int, which: int) -> np.ndarray:
        """The first ``size`` tokens in order ``which``."""
        hashed = mix(tokens + np.uint64(which * STEPS[1] % (1 << 64)))
        recurs = self.recurs(tokens)
        if not recurs.any():
            return tokens[np.argsort(hashed)[:size]]
        return tokens[np.lexsort((hashed, recurs if which == 0 else recurs > 0))[:size]]


def prefix_size(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def signature(tokens: np.ndarray) -> bytes:
    """Parity bits of the hashed tokens, at least two bits a token: the bits in which two signatures differ,
    folded to one size, are at most the tokens in which the sets differ."""
    bits = 1 << max(6, (2 * len(tokens) - 1).bit_length())
    found = np.bincount((mix(tokens + _LENGTH) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(found.astype(np.uint8)).tobytes()


def folded(raw: bytes, size: int) -> bytes:
    """A signature of at most ``size`` bytes."""
    x = np.frombuffer(raw, np.uint8)
    while len(x) > size:  # the top bit of the hash goes: halves fold
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the number of tokens in which two sets differ, by their signatures."""
    size = min(len(a), len(b))
    x, y = (np.frombuffer(folded(raw, size), np.uint8) for raw in (a, b))
    return int(np.bitwise_count(x ^ y).sum())


def texts_of(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_name"))


def encoded(batch: pa.RecordBatch) -> list[bytes]:
    return [t.as_buffer().to_pybytes() for t in batch.column("text")]


def named(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_name, class, n, signature) of each row; in rows without n the recurring tokens (class) and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        for batch in slices(batches):
            sets = list(token_sets(encoded(batch), width))
            classes, whole = [class_name(s) for s in sets], [signature(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_name"), pa.array(classes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(whole, pa.binary()), *(pa.array([folded(x, size) for x in whole], pa.binary()) for size in (SMALL_SIGNATURE, MIDDLE_SIGNATURE)), pa.nulls(len(sets), pa.int64())],
                names=["doc_id", "text_name", "class", "n", "signature", "small", "middle", "texts"],
            )
            once = list(dict(zip(classes, sets, strict=True)).values())
            token, texts = np.unique(np.concatenate(once), return_counts=True) if once else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = texts >= max(RECURS, RECURS_SHARE * len(once))
            none, empty = (pa.nulls(int(often.sum()), kind) for kind in (pa.int64(), pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [none, none, pa.array(token[often].view(np.int64)), none, empty, empty, empty, pa.array(texts[often].astype(np.int64))],
                names=["doc_id", "text_name", "class", "n", "signature", "small", "middle", "texts"],
            )

    return docs.mapInArrow(run, "doc_id long, text_name long, class long, n long, signature binary, small binary, middle binary, texts long")


def prefixes(docs: DataFrame, orders: Orders, width: int, percent: int) -> DataFrame:
    """(token, class, n, i, rare, often): the prefix of every class under the first order, how many of all its tokens are rare, and
    whether this one is frequent; a class once in each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = {}
            for tokens in token_sets(encoded(batch), width):
                if len(tokens) and (name := class_name(tokens)) not in found:
                    rare = int((orders.recurs(tokens) == 0).sum())
                    found[name] = (orders.prefix(tokens, prefix_size(len(tokens), percent), 0), len(tokens), rare)
            if not found:
                continue
            size = np.array([len(p) for p, _, _ in found.values()])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([p for p, _, _ in found.values()]).view(np.int64)),
                    pa.array(np.repeat(np.array(list(found), np.int64), size)),
                    pa.array(np.repeat(np.array([n for _, n, _ in found.values()], np.int32), size)),
                    pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in size.tolist()])),
                    pa.array(np.repeat(np.array([r for _, _, r in found.values()], np.int32), size)),
                    pa.array(orders.recurs(np.concatenate([p for p, _, _ in found.values()])) > 0),
                ],
                names=["token", "class", "n", "i", "rare", "often"],
            )

    return docs.mapInArrow(run, f"{MET}, often boolean")


def meeting(found: DataFrame) -> DataFrame:
    """The rows of prefixes() whose token several classes have, each class once.

    One exchange: rows are dealt out by token, those of frequent tokens by token and class, as they meet anyway. In the order of
    token and class a task tells repeated rows and lone tokens from the row before, however many rows a token has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row so far, and whether it was given out
        given = False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.concat_batches([held, batch])
            token, name, often = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("token", "class", "often"))
            other = np.concatenate([[True], token[1:] != token[:-1]])
            first = np.concatenate([[True], other[1:] | (name[1:] != name[:-1])])
            group = np.cumsum(other) - 1
            mixed = (np.bincount(group[first])[group] > 1) | often
            if given:
                mixed |= group == 0
            out = mixed & first
            out[0] &= not given
            last = int(np.flatnonzero(first)[-1])
            given = bool(out[last]) or (last == 0 and given)
            held = rows.slice(last, 1)
            yield rows.filter(pa.array(out)).select(["token", "class", "n", "i", "rare"])

    place = F.when(F.col("often"), F.xxhash64("token", "class")).otherwise(F.col("token"))
    return found.repartition(place).sortWithinPartitions("token", "class").mapInArrow(run, MET)


def can_link(a: str, b: str, percent: int) -> Column:
    """Sizes near enough, and enough tokens left from the shared one on."""
    n_a, n_b, i_a, i_b = (F.col(f"{x}.{y}").cast("long") for y in ("n", "i") for x in (a, b))
    rest = F.least(n_a - i_a, n_b - i_b)
    return (100 * n_a >= percent * n_b) & (100 * n_b >= percent * n_a) & ((100 + percent) * rest >= percent * (n_a + n_b))


def labelled(met: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of meeting() with the component of the class as label."""
    rows = met.join(labels.withColumnRenamed("node", "class"), "class", "left")
    return rows.withColumn("label", F.coalesce("component", "class")).drop("component")


def hub_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Each class with the hub of its size range under each token: the class with the fewest rare tokens, the one most like the others."""
    ranged = rows.withColumn("range", F.floor(F.log(F.col("n")) / F.log(F.lit(100 / percent))))
    one = F.struct("class", "n", "i")
    hubs = ranged.groupBy("token", "range").agg(F.min_by(one, F.struct("rare", F.xxhash64("class"), "class")).alias("hub"))
    both = ranged.join(hubs, ["token", "range"]).select(one.alias("x"), "hub")
    met = both.filter((F.col("x.class") != F.col("hub.class")) & can_link("x", "hub", percent))
    return met.select(F.least("x.class", "hub.class").alias("a"), F.greatest("x.class", "hub.class").alias("b")).distinct()


def with_both(pairs: DataFrame, classes: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` with these columns of both classes."""
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("class").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)
    return pairs


def passing(pairs: DataFrame, test) -> DataFrame:
    """The pairs (a, b) for which ``test`` holds, given a function that reads a column of a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            columns = {f.name: batch.column(f.name) for f in batch.schema}
            yes = pa.array([i for i in range(batch.num_rows) if test(lambda name, i=i: columns[name][i])], pa.int64())
            yield pa.RecordBatch.from_arrays([columns["a"].take(yes), columns["b"].take(yes)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def whole_sets(docs: DataFrame, pairs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(class, tokens) of the classes in ``pairs``, made anew from one text of each."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    ids = stored(classes.join(needed, "class", "left_semi").select("text_name"))
    if ids.count() <= SMALL:
        ids = F.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seen = {class_name(tokens): tokens for tokens in token_sets(encoded(batch), width)}
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array([t.tobytes() for t in seen.values()], pa.binary())], names=["class", "tokens"])

    found = docs.join(ids, "text_name", "left_semi").select("text").mapInArrow(run, "class long, tokens binary")
    return found.groupBy("class").agg(F.first("tokens").alias("tokens"))  # copies of a text give it again


def linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, orders: Orders, width: int, percent: int) -> DataFrame:
    """The pairs that link: by signature first, then under the other orders, then by whole sets."""

    def near(of) -> bool:
        sizes = of("n_a").as_py() + of("n_b").as_py()
        return (100 + percent) * least_difference(of("signature_a").as_buffer(), of("signature_b").as_buffer()) <= (100 - percent) * sizes

    def common(a: np.ndarray, b: np.ndarray) -> int:
        return len(np.intersect1d(a, b, assume_unique=True))

    def links(of) -> bool:
        a, b = (np.frombuffer(of(f"tokens_{side}").as_buffer(), np.uint64) for side in "ab")
        for which in (1, 2):
            if not common(*(orders.prefix(x, prefix_size(len(x), percent), which) for x in (a, b))):
                return False
        both = common(a, b)
        return 100 * both >= percent * (len(a) + len(b) - both)

    left = stored(passing(with_both(pairs, classes, "n", "signature"), near))
    return passing(with_both(left, whole_sets(docs, left, classes, width), "tokens"), links)


def with_links(labels: DataFrame, found: DataFrame) -> DataFrame:
    """The components after more links."""
    return stored(components(found.union(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))))


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The class of every row of ``docs`` (doc_id, text), and the component of every class.

    The first: doc_id, text_name, class, n. The second: class, component.
    """
    texts = texts_of(docs)
    first = stored_table(named(texts, width))
    rows = first.filter(F.col("n").isNotNull()).select("doc_id", "text_name", "class", "n")
    often = first.filter(F.col("n").isNull()).groupBy("class").agg(F.sum("texts").alias("texts")).orderBy(F.desc("texts"), "class").limit(FREQUENT).toPandas()
    orders = Orders(often["class"].to_numpy().astype(np.int64).view(np.uint64), often["texts"].to_numpy().astype(np.int64))
    classes = first.filter("n > 0").groupBy("class").agg(*(F.first(c).alias(c) for c in ("text_name", "n", "signature", "small", "middle")))
    met = stored_table(meeting(prefixes(texts, orders, width, percent)))

    hot = stored(hot_tokens(met))
    pairs = stored(hub_pairs(met, percent))
    links = stored(linked(pairs, texts, classes, orders, width, percent))
    labels, tried = stored(components(links)), pairs
    each, step, rest = BEST, 0, met
    while True:
        signatures = classes.select("class", F.col("middle" if step else "small").alias("small"))
        rows_left = labelled(rest, labels).join(signatures, "class").select("token", "class", "label", "n", "i", "small")
        sent = stored(pairs_in_tasks(rows_left, hot, percent, each))
        pairs = stored(as_pairs(sent).join(tried, ["a", "b"], "left_anti"))
        some = not pairs.isEmpty()
        if some:
            found = stored(linked(pairs, texts, classes, orders, width, percent))
            some = not found.isEmpty()
        if some:
            labels = with_links(labels, found)
        if each is None:
            break
        # a row that sent nothing has no partner any more, as components only grow
        alive = sent.select("token", F.explode(F.array("x", "y")).alias("class")).distinct()
        rest = stored_table(rest.join(alive, ["token", "class"], "left_semi"))
        tried, step = tried.union(pairs), step + 1
        each = BEST if some and step < ROUNDS else None
    return rows, labels.select(F.col("node").alias("class"), "component")


def near_copies(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_name, component (its name), n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    rows, labels = join(docs, width, percent)
    labelled = rows.join(labels, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = labelled.filter("n > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    return labelled.join(least, "component", "left").select(
        "doc_id", "text_name", "component", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")
    )


def first_copies(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without near copies of others: of each component the row with the smallest doc_id
    (NULL last), then the smallest text name, then the smallest other columns. Rows without words all stay."""
    found = near_copies(docs, width, percent)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_name")).alias("least")
    chosen = found.filter("n_shingles > 0").groupBy("component").agg(least).select("least.doc_id", "least.text_name", F.lit(True).alias("words"))
    empty = found.filter("n_shingles = 0").select("doc_id", "text_name", F.lit(False).alias("words")).distinct()
    kept = chosen.union(empty).withColumnsRenamed({"doc_id": "id__", "text_name": "name__", "words": "words__"})
    named_docs = docs.withColumn("text_name__", F.xxhash64(F.coalesce("text", F.lit(""))))
    on = (named_docs["text_name__"] == kept["name__"]) & named_docs["doc_id"].eqNullSafe(kept["id__"])
    joined = named_docs.join(kept, on)
    others = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and not kind.startswith(("map", "variant"))]
    first = F.row_number().over(Window.partitionBy("text_name__", "id__").orderBy("name__", *others))
    return joined.withColumn("first__", first).filter(~F.col("words__") | (F.col("first__") == 1)).select(*docs.columns)
