"""Distributions of one numeric column: counts, ECDF, quantiles, histograms, densities.

All of them start from ``value_counts``, one row per distinct value, so hot values are merged on
the map side. Ranks come from ``running_counts``, which never sorts the data in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.nulls import safe_div
from tidewell.operators.reshape import join_null_safe, left_join_null_safe


def value_counts(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct non-missing value: ``n`` rows carry it."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("n"))
    # Always true. It keeps ``n`` in passes that only need the values, so that all passes have
    # the same exchange and it is run once.
    return counts.where(F.col("n") > 0)


def slice_of(x: Column, bits: int) -> Column:
    """A whole number that never falls as the number ``x`` rises: 2 ** bits slices between a power of two and the next."""
    size = F.abs(x)
    exponent = F.least(F.floor(F.log2(size)), F.lit(2000))
    part = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * 2**bits)
    place = F.lit(1 << 40) + exponent * 2**bits + part
    beyond = size == F.lit(float("inf"))
    place = F.when(F.isnan(x), 1 << 42).when(size < 2.0**-1000, 1).when(beyond, 1 << 41).otherwise(place)
    return F.when(x == 0, 0).when(x < 0, -place).otherwise(place).cast("long")


def _slice_totals(counts: DataFrame, x: str, by: Sequence[str], bits: int, *more: Column) -> tuple[DataFrame, DataFrame]:
    """Value counts with their slice, and per group and slice the rows in it, below it (``__below``) and in the group (``n_total``)."""
    sliced = counts.withColumn("__slice", slice_of(F.col(x).cast("double"), bits))
    below = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, 0)
    totals = sliced.groupBy(*by, "__slice").agg(F.sum("n").alias("__n"), *more).withColumns(
        {"__below": F.sum("__n").over(below) - F.col("__n"), "n_total": F.sum("__n").over(Window.partitionBy(*by))}
    )
    return sliced, totals


def _through(sliced: DataFrame, totals: DataFrame, x: str, by: Sequence[str], how: str = "left") -> DataFrame:
    """``n_through`` and ``n_total`` of every value; with ``how="inner"`` of the slices in ``totals`` alone."""
    inside = Window.partitionBy(*by, "__slice").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    keys = [*by, "__slice"]
    joined = join_null_safe(sliced, totals.select(*keys, "__below", "n_total"), keys, how)
    return joined.withColumn("n_through", F.sum("n").over(inside) + F.col("__below")).drop("__slice", "__below")


def running_counts(counts: DataFrame, x: str, by: Sequence[str] = (), bits: int = 10) -> DataFrame:
    """Add ``n_through`` (rows at or below the value) and ``n_total`` to value counts.

    A plain running sum would need every value of a group in one task. Here the number line has fixed slices, ``2 ** bits`` of
    them from a power of two to the next (a thousandth of the value wide); the running sum is taken inside each slice and
    lifted by the totals of the slices below, of which a group has one row for each slice that it reaches.
    """
    sliced, totals = _slice_totals(counts, x, by, bits)
    return _through(sliced, totals, x, by).select(*counts.columns, "n_total", "n_through")


def ecdf(df: DataFrame, x: str, by: Sequence[str] = (), bits: int = 10) -> DataFrame:
    """Steps of the empirical distribution function, one row per distinct value; ``bits`` as in running_counts()."""
    steps = running_counts(value_counts(df, x, by), x, by, bits)
    return steps.select(*by, x, (F.col("n_through") / F.col("n_total")).alias("ecdf"))


def inverse_cdf(df: DataFrame, x: str, bits: int = 10, part: int = 100_000) -> DataFrame:
    """Every row's value with its cumulative share; missing values have no rank and are left out.

    Only the two columns come out, so the rows are made from the counts: a value is repeated as often
    as it occurs. A value shared by a large part of the rows is dealt out in parts of ``part`` rows.
    """
    steps = running_counts(value_counts(df, x), x, bits=bits)
    parts = steps.select(
        (F.col("n_through") / F.col("n_total")).alias("cume_dist"),
        x,
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(part).cast("long"))).alias("__from"),
        "n",
    )
    size = F.least(F.lit(part).cast("long"), F.col("n") - F.col("__from"))
    return parts.withColumn("__size", size).repartition("cume_dist", "__from").select(
        "cume_dist", x, F.explode(F.sequence(F.lit(1).cast("long"), "__size")).alias("__row")
    ).drop("__row")


def quantiles(
    df: DataFrame, x: str, probs: Sequence[float], by: Sequence[str] = (), interpolate: bool = True, bits: int = 10
) -> DataFrame:
    """Exact quantiles, one row per group and probability.

    Interpolated: position ``(n - 1) p`` between order statistics. Otherwise the smallest value
    whose cumulative share reaches ``p``. Exact percentiles hold a group's distinct values in one
    buffer; this picks the two order statistics out of the running counts instead.
    """
    return _pick_quantiles(running_counts(value_counts(df, x, by), x, by, bits), x, probs, by, interpolate)


def _pick_quantiles(
    steps: DataFrame, x: str, probs: Sequence[float], by: Sequence[str] = (), interpolate: bool = True
) -> DataFrame:
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probs]))
    total, through = F.col("n_total"), F.col("n_through")
    before = through - F.col("n")
    if not interpolate:
        hit = (through / total >= F.col("prob")) & ((before / total < F.col("prob")) | (before == 0))
        return steps.withColumn("prob", wanted).where(hit).select(*by, "prob", F.col(x).alias("quantile"))
    position = F.col("prob") * (total - 1)
    low, high = F.floor(position), F.ceil(position)
    # A value covers the 0-based positions before .. through - 1.
    covers_low = (low >= before) & (low < through)
    covers_high = (high >= before) & (high < through)
    picked = (
        steps.withColumn("prob", wanted)
        .where(covers_low | covers_high)
        .groupBy(*by, "prob")
        .agg(
            F.max(F.when(covers_low, F.col(x))).cast("double").alias("__lo"),
            F.max(F.when(covers_high, F.col(x))).cast("double").alias("__hi"),
            F.max(position - low).alias("__part"),
        )
    )
    between = F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__part")
    return picked.select(*by, "prob", between.alias("quantile"))


def _on_scale(df: DataFrame, x: str, log10: bool) -> DataFrame:
    """Values as drawn on the axis; a log axis has no place for non-positive ones."""
    kept = df.where(F.col(x) > 0) if log10 else df.where(F.col(x).isNotNull())
    return kept.withColumn("__x", F.log10(x) if log10 else F.col(x).cast("double"))


def histogram(
    df: DataFrame, x: str, bins: int, log10: bool = True, by: Sequence[str] = ()
) -> DataFrame:
    """Counts and relative frequencies in equal bins, the first one centred on the minimum.

    A single bin spans the minimum to the maximum.

    Bins are closed on the right and shared by all groups; empty ones are listed. The frequency
    is relative to all rows of the chart.
    """
    data = _on_scale(df, x, log10)
    extent = data.agg(
        F.struct(F.min("__x").alias("lo"), F.max("__x").alias("hi"), F.count(F.lit(1)).alias("total"))
    ).scalar()
    width = _bin_width(bins)
    first_edge = F.when(F.lit(bins == 1) & (F.col("__e.lo") < F.col("__e.hi")), F.col("__e.lo")).otherwise(F.col("__e.lo") - width / 2)
    single = F.col("__e.hi") == F.col("__e.lo")
    index = F.when(single | F.lit(bins == 1), 0).otherwise(F.greatest(F.ceil(safe_div(F.col("__x") - first_edge, width)) - 1, F.lit(0)))
    counted = data.withColumn("__e", extent).groupBy(*by, "__e", index.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # A group's bars as one map of at most ``bins`` entries, from which empty bins are read too.
    bars = counted.groupBy(*by, "__e").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("__n"))
    every = F.sequence(F.lit(0), F.when(single, 0).otherwise(bins - 1))
    n = F.coalesce(F.try_element_at("__n", F.col("bin")), F.lit(0))
    return (
        bars.withColumn("bin", F.explode(every))
        .select(
            *by,
            "bin",
            (first_edge + F.col("bin") * width).alias("x_min"),
            (first_edge + (F.col("bin") + 1) * width).alias("x_max"),
            n.alias("count"),
            (n / F.col("__e.total")).alias("frequency"),
        )
    )


def _bin_width(bins: int) -> Column:
    lo, hi = F.col("__e.lo"), F.col("__e.hi")
    # All values equal: one bin of a tenth.
    return F.when(hi == lo, F.lit(0.1)).otherwise((hi - lo) / max(bins - 1, 1))


def density(
    df: DataFrame, x: str, by: Sequence[str] = (), points: int = 512, log10: bool = True
) -> DataFrame:
    """Gaussian kernel density at ``points`` places over the range of all drawn values.

    Bandwidth per group: 0.9 min(sd, IQR / 1.34) n^(-1/5). The data enter as mass on a grid of
    ``points`` cells that reaches four bandwidths past the range, each value split linearly over
    its two neighbours; the density is read off that grid by linear interpolation. After the
    split a group has at most ``points`` rows, whatever its size, and the evaluation is
    ``points`` x ``points`` products (262,144 by default) per group. The plan is lazy. Size, moments, range and the places of
    the quartiles come from one aggregate per slice of the number line, the quartiles from the few slices that
    hold them; all passes share the exchange of the value counts.
    """
    by = list(by)
    counts = value_counts(_on_scale(df, x, log10), "__x", by)
    n, v = F.col("n"), F.col("__x")
    apart = F.sum(n * v * v) - F.sum(n * v) * F.sum(n * v) / F.sum(n)  # the values of a slice are near each other
    moments = [(F.sum(n * v) / F.sum(n)).alias("__mean"), F.greatest(apart, F.lit(0.0)).alias("__apart"), F.min(v).alias("__least"), F.max(v).alias("__most")]
    sliced, totals = _slice_totals(counts, "__x", by, 10, *moments)
    # slices that hold an order statistic beside a quartile, and all that the group's other figures need
    quartile = [0.25 * (F.col("n_total") - 1), 0.75 * (F.col("n_total") - 1)]
    through = F.col("__below") + F.col("__n")
    holds = [(F.col("__below") <= p) & (p < through) for q in quartile for p in (F.floor(q), F.ceil(q))]
    near = totals.where(reduce(lambda a, b: a | b, holds))
    quartiles = _pick_quantiles(_through(sliced, near, "__x", by, "inner"), "__x", [0.25, 0.75], by)
    spread = quartiles.groupBy(*by).agg((F.max("quantile") - F.min("quantile")).alias("__iqr"))
    size, whole = F.sum("__n"), Window.partitionBy()
    off = F.col("__mean") - F.col("__from")
    squares = F.sum(F.col("__apart") + F.col("__n") * off * off) - F.sum(F.col("__n") * off) * F.sum(F.col("__n") * off) / size
    known = totals.withColumn("__from", F.min("__least").over(Window.partitionBy(*by))).groupBy(*by).agg(
        size.alias("__n"),
        F.sqrt(F.greatest(safe_div(squares, size - 1), F.lit(0.0))).alias("__sd"),
        F.min("__least").alias("__first"),
        F.max("__most").alias("__last"),
    )
    known = left_join_null_safe(known, spread, by) if by else known.withColumn("__iqr", spread.scalar())
    rule = F.least("__sd", F.col("__iqr") / 1.34)
    # Same fall-backs as the usual rule of thumb when the spread is zero.
    scale = F.coalesce(
        F.when(rule > 0, rule), F.when(F.col("__sd") > 0, F.col("__sd")),
        F.when(F.col("__first") != 0, F.abs("__first")), F.lit(1.0),
    )
    extent = F.struct(F.min("__first").over(whole).alias("lo"), F.max("__last").over(whole).alias("hi"))  # one row per group
    groups = known.select(
        *by, "__n", (0.9 * scale * F.pow(F.col("__n").cast("double"), F.lit(-0.2))).alias("__bw"), extent.alias("__e")
    ).where(F.col("__n") > 1)
    lo, hi = F.col("__e.lo"), F.col("__e.hi")
    low = lo - 4 * F.col("__bw")
    step = (hi + 4 * F.col("__bw") - low) / (points - 1)
    place = (F.col("__x") - low) / step
    cell = F.floor(place)
    part = place - cell
    # A value lies between two cells and gives each the share it is close to.
    halves = F.explode(
        F.array(
            F.struct(cell.alias("cell"), (n * (1 - part)).alias("mass")),
            F.struct((cell + 1).alias("cell"), (n * part).alias("mass")),
        )
    )
    mass = (
        _attach(counts, groups, by)
        .select(*by, "__n", "__bw", "__e", halves.alias("h"))
        .groupBy(*by, "__n", "__bw", "__e", F.col("h.cell").alias("__cell"))
        .agg(F.sum("h.mass").alias("__mass"))
    )
    offset = (F.col("x") - low) / step
    near = F.floor(offset)
    weight = offset - near

    def bell(at: Column) -> Column:
        z = (at - F.col("__cell")) * step / F.col("__bw")
        return F.exp(-0.5 * z * z)

    kernel = F.col("__mass") * ((1 - weight) * bell(near) + weight * bell(near + 1))
    area = F.col("__n") * F.col("__bw") * math.sqrt(2 * math.pi)
    return (
        mass.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", lo + F.col("point") * (hi - lo) / (points - 1))
        .groupBy(*by, "point", "x")
        .agg(F.sum(kernel / area).alias("density"))
    )


def _attach(df: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Size, bandwidth and range beside a row; rows of groups without a bandwidth go."""
    if by:
        return left_join_null_safe(df, groups, by).where(F.col("__bw").isNotNull())
    one = groups.select(F.struct("__n", "__bw", "__e")).scalar()
    return df.withColumn("__g", one).where(F.col("__g").isNotNull()).select(*df.columns, "__g.__n", "__g.__bw", "__g.__e")
