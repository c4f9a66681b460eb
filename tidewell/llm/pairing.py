"""Pairs of classes that can link, found inside tasks: a pair leaves its task only after all filters that need no whole set.

Rows of a token come together, a token that many rows hold in blocks of bounded size, of which each two meet. Within a group all
pairs of different components go through the size, position and signature filters as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.kept import trim

#: Rows of a token that meet in one group; more are cut into blocks.
MOST = 1 << 15
#: Pairs looked at together, and words of their signatures.
PAIRS, WORDS = 1 << 17, 1 << 18


def hot_tokens(rows: DataFrame, most: int = MOST) -> DataFrame:
    """(token, blocks) of the tokens that more than ``most`` rows hold; other rounds with fewer rows may use it too."""
    return rows.groupBy("token").count().filter(F.col("count") > most).select("token", F.ceil(F.col("count") / most).cast("int").alias("blocks"))


def dealt(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` with lo, hi and side, once for each group that a row is in: (token, lo, hi)."""
    own = rows.join(hot, "token", "left").withColumn("side", F.coalesce(F.pmod(F.xxhash64("class"), F.col("blocks")), F.lit(0)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("other")
    met = own.select("*", other)
    grouped = met.select(*rows.columns, "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"))
    return grouped.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "n")


class Signatures:
    """Signatures of different lengths (powers of two), folded to the shorter of two when they are compared."""

    def __init__(self, raw: list[bytes]):
        self.words = np.array([len(r) // 8 for r in raw], np.int64)
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        above, rows_above = None, np.zeros(0, np.int64)
        width = int(self.words.max(initial=1))
        while width >= 1:
            own = np.flatnonzero(self.words == width)
            table = np.frombuffer(b"".join([raw[i] for i in own.tolist()]), np.uint64).reshape(len(own), width)
            rows = own
            if above is not None and len(rows_above):
                table = np.concatenate([table, above[:, :width] ^ above[:, width:]])
                rows = np.concatenate([own, rows_above])
            place = np.zeros(len(raw), np.int64)
            place[rows] = np.arange(len(rows))
            self.levels[width] = (table, place)
            above, rows_above, width = table, rows, width // 2

    def differing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """A lower bound of the tokens in which the sets i and j differ."""
        out = np.zeros(len(i), np.int64)
        width = np.minimum(self.words[i], self.words[j])
        for w in np.unique(width).tolist():
            table, place = self.levels[w]
            here = np.flatnonzero(width == w)
            step = max(1, WORDS // w)
            for at in range(0, len(here), step):
                part = here[at : at + step]
                out[part] = np.bitwise_count(table[place[i[part]]] ^ table[place[j[part]]]).sum(axis=1)
        return out


def found_in(table: pa.Table, percent: int, each: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens and classes of the pairs that pass, of whole groups sorted by token, lo, hi and n; with ``each`` at most the best so many of a row."""
    none = np.zeros(0, np.int64)
    if not table.num_rows:
        return none, none, none
    token, lo, hi, side, name, label, n, at = (table.column(c).to_numpy().astype(np.int64) for c in ("token", "lo", "hi", "side", "class", "label", "n", "i"))
    signatures = Signatures(table.column("small").to_pylist())
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
    group = np.cumsum(new) - 1
    # partners come after a row, in its group, and are not too large for it
    reach = int(n.max()) * 100 // percent + 1
    stop = np.searchsorted(group * (reach + 1) + n, group * (reach + 1) + n * 100 // percent, "right")
    many = stop - np.arange(len(token)) - 1
    total = np.cumsum(many)
    left, right, apart = [none], [none], [np.zeros(0)]
    row = 0
    while row < len(many):
        to = max(row + 1, int(np.searchsorted(total, (total[row - 1] if row else 0) + PAIRS, "right")))
        size = many[row:to]
        i = np.repeat(np.arange(row, to), size)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size)
        row = to
        ok = (label[i] != label[j]) & ((lo[i] == hi[i]) | (side[i] != side[j]))
        i, j = i[ok], j[ok]
        rest = np.minimum(n[i] - at[i], n[j] - at[j])
        ok = (100 * n[i] >= percent * n[j]) & (100 * n[j] >= percent * n[i]) & ((100 + percent) * rest >= percent * (n[i] + n[j]))
        i, j = i[ok], j[ok]
        differ = signatures.differing(i, j)
        ok = (100 + percent) * differ <= (100 - percent) * (n[i] + n[j])
        left.append(i[ok])
        right.append(j[ok])
        apart.append(differ[ok] / (n[i] + n[j])[ok])
    i, j, share = np.concatenate(left), np.concatenate(right), np.concatenate(apart)
    if each is not None and len(i):
        rows, others = np.concatenate([i, j]), np.concatenate([j, i])
        order = np.lexsort((name[others], np.concatenate([share, share]), rows))
        first = np.concatenate([[True], rows[order][1:] != rows[order][:-1]])
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        kept = order[rank < each]
        i, j = rows[kept], others[kept]
    return token[i], name[i], name[j]


def pairs_in_tasks(rows: DataFrame, hot: DataFrame, percent: int, each: int | None) -> DataFrame:
    """(token, x, y): classes of different labels that share a token and pass the filters.

    ``rows`` has token, class, label, n, i and small (the folded signature); ``hot`` is of hot_tokens(). With ``each`` a row (x) gives its best so many partners
    under a token at most, which keeps what is sent in proportion to the rows; without, every pair that passes comes once or twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None

        def result(table: pa.Table) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found_in(table, percent, each)], names=["token", "x", "y"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if kept is None else pa.concat_tables([kept, table])
            keys = np.stack([table.column(c).to_numpy() for c in ("token", "lo", "hi")])
            last = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
            if cut:
                yield result(table.slice(0, cut))
            kept = table.slice(cut).combine_chunks()
            trim()
        if kept is not None:
            yield result(kept)

    return dealt(rows, hot).mapInArrow(run, "token long, x long, y long")


def as_pairs(found: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of pairs_in_tasks()."""
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
