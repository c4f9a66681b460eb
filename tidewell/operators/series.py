"""Running values of long series, block by block.

A plain running window holds a whole key in one task. Here a series falls into blocks that follow each other: of time,
where the caller names them, or slices of nearly equal size. Rows are dealt out by block once. That exchange gives the running values
inside each block and one summary per block; the summaries are scanned in order, and lift the blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.nulls import safe_div
from tidewell.operators.ranking import sliced
from tidewell.operators.reshape import left_join_null_safe

#: What ``running`` knows: strict running sum and maximum, strict product of the rows before (1 where it is missing), last known value.
KINDS = ("sum", "max", "product_before", "last")


def in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column | None = None, levels: int = 8) -> DataFrame:
    """``df`` with ``__block``, which never falls along ``order`` within a key, dealt out by key and block."""
    placed = sliced(df, [*keys, *order], levels, "__block") if block is None else df.withColumn("__block", block)
    return placed.repartition(*keys, "__block")


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, tuple[str, str]], block: Column | None = None, levels: int = 8
) -> DataFrame:
    """Add running values along ``order`` (ascending, total within a key): ``values`` maps a new column to (kind, column).

    After a missing value a sum and a maximum are missing, and a product is 1, as in the strict windows; "last" skips missing values.
    Columns of ``df`` may be replaced. ``block`` is a column that never falls along the order, such as the month; without one
    2 ** levels slices are cut. Sums and products may differ from a plain window in their last digits.
    """
    if unknown := {kind for kind, _ in values.values()} - set(KINDS):
        raise ValueError(f"unknown kinds: {sorted(unknown)}")
    dealt = in_blocks(df, keys, order, block, levels)
    by, along = [*keys, "__block"], [F.asc_nulls_first(c) for c in order]
    place = F.struct(*order)
    through = Window.partitionBy(*by).orderBy(*along).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy(*along).rowsBetween(Window.unboundedPreceding, -1)
    columns = list(dict.fromkeys(c for _, c in values.values()))
    totals, inside = [F.max(F.xxhash64(*df.columns)).alias("__any")], {}
    for i, c in enumerate(columns):
        x, kinds = F.col(c), {kind for kind, of in values.values() if of == c}
        totals.append(F.count_if(x.isNull()).alias(f"__gaps_{i}"))
        inside[f"__in_gaps_{i}"] = F.count_if(x.isNull()).over(through)
        inside[f"__in_gaps_before_{i}"] = F.count_if(x.isNull()).over(before)
        for kind, whole, part in (
            ("sum", F.sum(x), F.sum(x).over(through)),
            ("max", F.max(x), F.max(x).over(through)),
            ("product_before", F.product(x), F.product(x).over(before)),
            ("last", F.max_by(x, F.when(x.isNotNull(), place)), F.last(x, ignorenulls=True).over(through)),
        ):
            if kind in kinds:
                totals.append(whole.alias(f"__{kind}_{i}"))
                inside[f"__in_{kind}_{i}"] = part
    # asking for the hash, which is never missing, keeps all columns: the rows use the same exchange
    blocks = dealt.groupBy(*by).agg(*totals).where(F.col("__any").isNotNull()).drop("__any")
    lower = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("__block")).rowsBetween(Window.unboundedPreceding, -1)
    scan = {"__gaps": F.sum, "__sum": F.sum, "__max": F.max, "__product_before": F.product, "__last": lambda c: F.last(c, ignorenulls=True)}
    lifts = {f"__up_{name[2:]}": scan[name.rpartition("_")[0]](name).over(lower) for name in blocks.columns if name not in by}
    lifted = left_join_null_safe(dealt.withColumns(inside), blocks.select(*by, *(c.alias(n) for n, c in lifts.items())), by)
    out = {}
    for new, (kind, c) in values.items():
        i = columns.index(c)
        up, own = F.col(f"__up_{kind}_{i}"), F.col(f"__in_{kind}_{i}")
        none_above = F.coalesce(f"__up_gaps_{i}", F.lit(0)) == 0
        out[new] = {
            "sum": F.when(none_above & (F.col(f"__in_gaps_{i}") == 0), own + F.coalesce(up, F.lit(0))),
            "max": F.when(none_above & (F.col(f"__in_gaps_{i}") == 0), F.greatest(own, up)),
            "product_before": F.when(none_above & (F.col(f"__in_gaps_before_{i}") == 0), F.coalesce(own, F.lit(1.0)) * F.coalesce(up, F.lit(1.0))),
            "last": F.coalesce(own, up),
        }[kind]
        if kind == "product_before":
            out[new] = F.coalesce(out[new], F.lit(1.0))
    kept = [c for c in df.columns if c not in out]
    return lifted.select(*kept, *(c.alias(n) for n, c in out.items()))


def ffill_long(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], block: Column | None = None, levels: int = 8) -> DataFrame:
    """Last known value of each column within ``keys``, for series of any length."""
    filled = running(df, keys, order, {c: ("last", c) for c in cols}, block, levels)
    return filled.select(*df.columns)


def worst_fall(df: DataFrame, keys: Sequence[str], order: Sequence[str], factor: str, block: Column | None = None, levels: int = 8) -> DataFrame:
    """The largest fall of a compounded series from its peak, per key; the series starts at 1 and ``factor`` (positive or zero) moves it.

    A block is summed up by its last value, peak, trough and own worst fall, relative to where it starts. Blocks merge in any grouping:
    the worst fall of two is that of the first, of the second, or from the first's peak to the second's trough.
    """
    dealt = in_blocks(df.where(F.col(factor).isNotNull()), keys, order, block, levels)
    by = [*keys, "__block"]
    along = Window.partitionBy(*by).orderBy(*(F.asc_nulls_first(c) for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    moved = dealt.withColumn("__level", F.product(factor).over(along))
    moved = moved.withColumn("__peak", F.max("__level").over(along))
    blocks = moved.groupBy(*by).agg(
        F.max_by("__level", F.struct(*order)).alias("__end"),
        F.max("__peak").alias("__peak"),
        F.min("__level").alias("__trough"),
        F.max(1 - safe_div(F.col("__level"), F.col("__peak"))).alias("__fall"),
    )
    lower = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("__block")).rowsBetween(Window.unboundedPreceding, -1)
    started = blocks.withColumn("__start", F.coalesce(F.product("__end").over(lower), F.lit(1.0)))
    above = started.withColumn("__top", F.greatest(F.max(F.col("__start") * F.col("__peak")).over(lower), F.lit(1.0)))
    falls = F.greatest("__fall", 1 - safe_div(F.col("__start") * F.col("__trough"), F.col("__top")))
    return above.groupBy(*keys).agg(F.max(F.greatest(falls, F.lit(0.0))).alias("fall"))

