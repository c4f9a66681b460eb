"""Sizes of liquidity positions by pool and chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.names import pool_short_name, short_name_chain
from tidewell.functions.nulls import safe_div, sum_strict
from tidewell.operators import distribution
from tidewell.operators.reshape import left_join_null_safe, top_with_ties


def latest_liquidity(pool_liquidity: DataFrame) -> DataFrame:
    """One row per pool: the latest day's."""
    latest = pool_liquidity.groupBy("pool_name").agg(
        F.max("day").alias("day"), F.max_by("total_liquidity_usd", "day").alias("total_liquidity_usd")
    )
    return latest.withColumn("pool_name_short", pool_short_name(F.col("pool_name"))).withColumn(
        "chain", short_name_chain(F.col("pool_name_short"))
    )


def value_lp_positions(positions: DataFrame, pool_liquidity: DataFrame) -> DataFrame:
    """Open positions in USD: the position's part of its pool times the pool's liquidity.

    Pool totals are aggregated and joined to the pool table first, so the positions are joined
    once, to one row per pool. A pool holding a third of all positions is no problem while that
    table is small enough to broadcast, and a skew join otherwise.
    """
    open_positions = positions.where(F.col("lp_position") > 0)
    pools = left_join_null_safe(
        open_positions.groupBy("pool_name").agg(F.sum("lp_position").alias("total_lp_position")),
        latest_liquidity(pool_liquidity).select("pool_name", "total_liquidity_usd"),
        ["pool_name"],
    )
    part = safe_div(F.col("lp_position"), F.col("total_lp_position"))
    return (
        left_join_null_safe(open_positions, pools, ["pool_name"])
        .withColumn("lp_position_usd", part * F.col("total_liquidity_usd"))
        .withColumn("pool_name_short", pool_short_name(F.col("pool_name")))
        .withColumn("chain", short_name_chain(F.col("pool_name_short")))
    )


def _pool_sizes(lp: DataFrame) -> DataFrame:
    sizes = lp.groupBy("pool_name_short").agg(sum_strict("lp_position_usd").alias("lp_position_usd"))
    return sizes.where(F.col("lp_position_usd") > 0)


def split_top_pools(lp: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """The ``n`` largest pools, exactly ``n`` even with ties, and the others."""
    sizes = _pool_sizes(lp)
    top = sizes.orderBy(F.desc("lp_position_usd"), "pool_name_short").limit(n)
    return top, sizes.join(top.select("pool_name_short"), "pool_name_short", "left_anti")


def default_pools(lp: DataFrame, n: int = 1) -> DataFrame:
    """The pools preselected in a view: the largest ``n`` with ties."""
    return top_with_ties(split_top_pools(lp)[0], "lp_position_usd", n)


def default_chains(pool_liquidity: DataFrame, n: int = 2) -> DataFrame:
    chains = latest_liquidity(pool_liquidity).groupBy("chain").agg(
        sum_strict("total_liquidity_usd").alias("total_liquidity_usd")
    )
    return top_with_ties(chains, "total_liquidity_usd", n)


def league_table(lp: DataFrame, by: str = "pool") -> DataFrame:
    """Providers and value per pool or chain, ranked by value.

    Per pool a missing valuation makes the total missing and unranked; per chain it is skipped.
    """
    keys, total = {
        "pool": (["pool_name_short", "chain"], sum_strict("lp_position_usd")),
        "chain": (["chain"], F.coalesce(F.sum("lp_position_usd"), F.lit(0.0))),
    }[by]
    table = lp.groupBy(*keys).agg(F.count(F.lit(1)).alias("liquidity_providers"), total.alias("tvl"))
    # one row per pool or chain: few enough to be numbered in one task
    number = F.row_number().over(Window.orderBy(F.desc_nulls_last("tvl"), *map(F.asc_nulls_first, keys)))
    return table.withColumn("rank", F.when(F.col("tvl").isNotNull(), number.cast("long")))


def _distribution(df: DataFrame, x: str, kind: str, bins: int, by: Sequence[str]) -> DataFrame:
    if kind == "histogram":
        return distribution.histogram(df, x, bins, by=by)
    if kind == "density":
        return distribution.density(df, x, by=by)
    if kind == "ecdf":
        return distribution.ecdf(df, x, by=by)
    raise ValueError(f"kind must be histogram, density or ecdf, not {kind!r}")


def lp_distribution(
    lp: DataFrame,
    selection: Sequence[str] | DataFrame | None,
    kind: str,
    by: str | None = None,
    bins: int = 20,
) -> DataFrame:
    """Distribution of position sizes in the selected pools or, with ``by='chain'``, chains.

    ``by`` is None (pooled), ``pool`` or ``chain``. The selection is a list of names, or a
    DataFrame with the name column, such as ``default_pools``.
    """
    key = "chain" if by == "chain" else "pool_name_short"
    chosen = lp.where(F.col("lp_position_usd") > 0)
    if isinstance(selection, DataFrame):
        chosen = chosen.join(selection.select(key), key, "left_semi")
    elif selection is not None:
        chosen = chosen.where(F.col(key).isin(list(selection)))
    return _distribution(chosen, "lp_position_usd", kind, bins, [key] if by else [])


def tvl_distribution(pool_liquidity: DataFrame, kind: str, by: str = "pool") -> DataFrame:
    """Distribution of total liquidity over pools (10 bins) or chains (5 bins)."""
    sizes = latest_liquidity(pool_liquidity)
    bins = 10
    if by == "chain":
        sizes = sizes.groupBy("chain").agg(sum_strict("total_liquidity_usd").alias("total_liquidity_usd"))
        bins = 5
    return _distribution(sizes.where(F.col("total_liquidity_usd") > 0), "total_liquidity_usd", kind, bins, [])
