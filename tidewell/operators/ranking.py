"""Row numbers over a whole table or large groups, and the first rows alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.reshape import left_join_null_safe

#: Rows of the sample for each slice; more would only make the slices more equal.
PER_SLICE = 16


def _ordering(key: str) -> Column:
    return F.desc_nulls_last(key[1:]) if key.startswith("-") else F.asc_nulls_first(key)


def _before(cut: Column, keys: Sequence[str]) -> Column:
    """Whether the row ``cut`` (a struct of the keys' columns) comes before this row."""
    out = F.lit(False)
    for key in reversed(keys):
        name = key.removeprefix("-")
        a, b = cut[name], F.col(name)
        less = (a.isNotNull() & b.isNull()) | (a > b) if key.startswith("-") else (a.isNull() & b.isNotNull()) | (a < b)
        out = F.coalesce(less, F.lit(False)) | (a.eqNullSafe(b) & out)
    return out


def sliced(df: DataFrame, keys: Sequence[str], levels: int, name: str = "__slice") -> DataFrame:
    """Add ``name``: 2 ** levels slices of nearly equal size that follow each other in the order of ``keys``.

    The cuts are rows of the table: those with the smallest hashes are an even sample, which any run draws alike.
    Strings are cut where strings are, whatever they have in common.
    """
    names, size = [k.removeprefix("-") for k in keys], 2**levels * PER_SLICE
    sample = df.select(*names).orderBy(F.xxhash64(*names), *names).limit(size)
    along = Window.orderBy(*map(_ordering, keys))  # over the sample alone
    placed = sample.select(F.struct(*names).alias("__cut"), F.row_number().over(along).alias("__n"), F.count(F.lit(1)).over(Window.partitionBy()).alias("__of"))
    per = F.ceil(F.col("__of") / (2**levels - 1))
    cuts = placed.where(F.col("__n") % per == 0).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__cut"))), lambda x: x["__cut"])).scalar()
    halves = F.array(*(F.lit(2**k) for k in reversed(range(levels))))

    def further(found: Column, half: Column) -> Column:  # a step of a binary search for the number of cuts before the row
        at = found + half - 1
        return found + F.when((at < F.size("__cuts")) & _before(F.get("__cuts", at), keys), half).otherwise(0)

    return df.withColumn("__cuts", cuts).withColumn(name, F.aggregate(halves, F.lit(0), further)).drop("__cuts")


def number_rows(
    df: DataFrame, *order: str, by: Sequence[str] = (), name: str = "rank", levels: int = 8, top: int | None = None
) -> DataFrame:
    """Add 1, 2, ... in the given order, which must be total, over the table or within ``by``.

    ``order`` lists columns, "-" before one for descending. With ``top`` only the first so many rows (of each group) come
    out, and rows beyond go before the shuffle: Spark's top-k, or its window group limit.

    Without ``top`` all rows are numbered. A plain window would sort each group, or the whole table, in one task. Here an even
    sample cuts the table into slices that follow each other, rows are dealt out by slice once, and that exchange gives
    both the sizes of the slices, whose running sums tell where a slice starts, and the rows, which are sorted within their
    slice. So the input is read for the sample and once more. The cuts decide on balance alone. The plan is lazy.
    """
    if top is not None and not by:
        first = df.orderBy(*map(_ordering, order)).limit(top)
        return first.withColumn(name, F.row_number().over(Window.orderBy(*map(_ordering, order))).cast("long"))
    if top is not None:
        number = F.row_number().over(Window.partitionBy(*by).orderBy(*map(_ordering, order)))
        return df.withColumn("__rank", number).where(F.col("__rank") <= top).withColumn(name, F.col("__rank").cast("long")).drop("__rank")
    sets = [*by, "__slice"]
    dealt = sliced(df, [*by, *order], levels).repartition(*sets)
    # The hash is never missing; asking for it keeps all columns, so that both uses have the same exchange.
    sizes = dealt.groupBy(*sets).agg(F.count(F.lit(1)).alias("__n"), F.max(F.xxhash64(*df.columns)).alias("__any")).where(F.col("__any").isNotNull())
    # at most one row for each group and slice
    lower = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, 0)
    starts = sizes.select(*sets, (F.sum("__n").over(lower) - F.col("__n")).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(*sets).orderBy(*map(_ordering, order)))
    numbered = left_join_null_safe(dealt.withColumn("__inside", inside), starts, sets)
    return numbered.withColumn(name, (F.col("__start") + F.col("__inside")).cast("long")).drop("__slice", "__inside", "__start")
