"""Large wallets and what they swap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.calendar import week_ceiling
from tidewell.functions.nulls import safe_div
from tidewell.operators import distribution
from tidewell.operators.reshape import complete_grid, left_join_null_safe, n_distinct


def balance_summary(whales: DataFrame) -> DataFrame:
    """Count, maximum, mean, exact median and minimum of the balances, one row."""
    median = distribution.quantiles(whales, "balance", [0.5]).select("quantile").scalar()
    return whales.agg(
        F.count(F.lit(1)).alias("count"),
        F.max("balance").alias("max_balance"),
        F.avg("balance").alias("avg_balance"),
        F.min("balance").alias("min_balance"),
    ).withColumn("median_balance", median)


def wallet_listing(whales: DataFrame) -> DataFrame:
    return whales.select("address", "balance").orderBy(F.desc_nulls_last("balance"), "address")


def swaps_by_wallet(swaps: DataFrame) -> DataFrame:
    return swaps.groupBy("swapper").agg(F.count(F.lit(1)).alias("swaps"))


def participation(whales: DataFrame, swaps: DataFrame) -> DataFrame:
    """How many of the whales swapped at all."""
    counts = swaps_by_wallet(swaps).withColumnRenamed("swapper", "address")
    swapped = left_join_null_safe(whales.select("address"), counts, ["address"])
    answer = F.when(F.coalesce("swaps", F.lit(0)) > 0, "yes").otherwise("no")
    groups = swapped.groupBy(answer.alias("has_swapped")).agg(F.count(F.lit(1)).alias("count"))
    total = groups.agg(F.sum("count")).scalar()
    return groups.withColumn("percentage", safe_div(F.col("count"), total))


def swaps_per_whale(swaps: DataFrame, bins: int = 40) -> DataFrame:
    """Histogram of swaps per wallet, on a linear axis."""
    return distribution.histogram(swaps_by_wallet(swaps), "swaps", bins, log10=False)


def _side(swaps: DataFrame, side: str) -> DataFrame:
    return swaps.groupBy(F.col(f"swap_{side}_name").alias("asa")).agg(
        n_distinct("swapper").alias(f"whales_{side}"), F.count(F.lit(1)).alias(f"swaps_{side}")
    )


def asset_flow_summary(swaps: DataFrame, how: str = "left") -> DataFrame:
    """Whales and swaps per asset, from and to.

    ``left`` keeps the assets swapped from, with missing totals where nobody swapped to them;
    ``full`` also keeps those only swapped to. A wallet on both sides counts twice.
    """
    origin, target = _side(swaps, "from"), _side(swaps, "to").withColumnRenamed("asa", "asa_to")
    both = origin.join(target, F.col("asa").eqNullSafe(F.col("asa_to")), how)
    return both.select(
        F.coalesce("asa", "asa_to").alias("asa"),
        (F.col("whales_from") + F.col("whales_to")).alias("whales"),
        "swaps_from", "swaps_to",
        (F.col("swaps_from") + F.col("swaps_to")).alias("swaps"),
    ).orderBy(F.desc_nulls_last("swaps"), "asa")


def weekly_dense_counts(swaps: DataFrame, side: str) -> DataFrame:
    """Swaps and distinct whales per week (named by the Sunday that ends it) and asset.

    Every observed week is paired with every observed asset: 0 swaps where there were none, and
    no whale count.
    """
    asset = f"swap_{side}_name"
    weekly = swaps.withColumn("week", week_ceiling("block_timestamp"))
    counts = weekly.groupBy("week", asset).agg(
        n_distinct("swapper").alias("whales"), F.count(F.lit(1)).cast("double").alias("swaps")
    )
    dense = complete_grid(counts, "week", asset, ["whales", "swaps"])
    return dense.select("week", asset, "whales", F.coalesce("swaps", F.lit(0.0)).alias("swaps"))
