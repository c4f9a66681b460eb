"""Value locked in pools with the price effect taken out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.names import pool_chain, pool_token
from tidewell.functions.nulls import running_sum_strict, sum_strict
from tidewell.operators.reshape import carry_to_next, ffill, left_join_null_safe, to_long

METRICS = ("dollar_value_locked", "dollar_value_gained", "tvl", "normalized_tvl")


def tvl_metrics(pool_daily: DataFrame) -> DataFrame:
    """Per pool and day: value put in, gained by prices, in all, and at the pool's latest prices.

    Days without a row take the last known values, from the pool's first day on. All windows
    share one exchange by pool and see one row per day of a pool.
    """
    w = Window.partitionBy("pool_name").orderBy("day")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    net = F.col("added_liquidity_usd") - F.col("withdrawn_liquidity_usd")
    normalized = F.col("asset_liquidity") * F.last("asset_price_usd").over(whole) + F.col(
        "rune_liquidity"
    ) * F.last("rune_price_usd").over(whole)
    observed = (
        pool_daily.withColumn("dollar_value_locked", running_sum_strict(net, w))
        .withColumn("dollar_value_gained", F.col("tvl") - F.col("dollar_value_locked"))
        .withColumn("normalized_tvl", normalized)
        .select("day", "pool_name", *METRICS)
    )
    known = ffill(observed, ["pool_name"], ["day"], METRICS)
    return (
        carry_to_next(known, "pool_name", "day")
        .where(F.col("dollar_value_locked").isNotNull())
        .withColumns({"blockchain": pool_chain(F.col("pool_name")), "token": pool_token(F.col("pool_name"))})
    )


def protocol_tvl(
    metrics: DataFrame, variables: Sequence[str] = ("dollar_value_locked", "tvl", "normalized_tvl")
) -> DataFrame:
    """Daily totals over all pools, long form."""
    daily = metrics.groupBy("day").agg(*[sum_strict(v).alias(v) for v in variables])
    return to_long(daily, ["day"], list(variables), "variable", "value")


def _totals(metrics: DataFrame, *by: str) -> DataFrame:
    return metrics.groupBy("day", *by).agg(
        *[sum_strict(v).alias(v) for v in ("dollar_value_locked", "normalized_tvl", "tvl")]
    )


def tvl_by_chain(metrics: DataFrame) -> DataFrame:
    return _totals(metrics, "blockchain")


def tvl_by_chain_token(metrics: DataFrame, chain: str | None = None) -> DataFrame:
    """Every chain in one job, or a single one."""
    if chain is not None:
        metrics = metrics.where(F.col("blockchain") == chain)
    return _totals(metrics, "blockchain", "token")


def reconcile_tvl(metrics: DataFrame, platform: DataFrame) -> DataFrame:
    """Own total beside the platform's, long form; days the platform skipped are NULL."""
    own = metrics.groupBy("day").agg(sum_strict("tvl").alias("tvl"))
    both = left_join_null_safe(own, platform.select("day", "total_value_pooled_usd"), ["day"])
    return to_long(both, ["day"], ["tvl", "total_value_pooled_usd"], "variable", "value")
