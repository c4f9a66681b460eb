"""Distributions over wallets: activity and holdings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import distribution


def log_histogram(df: DataFrame, x: str, bins: int = 18, freq: bool = True) -> DataFrame:
    """Histogram on a log axis; relative frequencies unless ``freq`` is off."""
    bars = distribution.histogram(df, x, bins, log10=True)
    return bars.drop("count") if freq else bars.drop("frequency")


def inverse_cdf(df: DataFrame, x: str) -> DataFrame:
    return distribution.inverse_cdf(df, x)


def quantile_table(df: DataFrame, x: str, probs: Sequence[float]) -> DataFrame:
    """Which value a given share of the wallets does not exceed."""
    return distribution.quantiles(df, x, probs, interpolate=False)


def clamp_and_rank_holdings(balances: DataFrame) -> DataFrame:
    """Totals below zero become zero; largest first, missing last."""
    total = F.col("rune_total_balance")
    return balances.withColumn("rune_total_balance", F.when(total < 0, F.lit(0.0)).otherwise(total)).orderBy(
        F.desc_nulls_last("rune_total_balance"), "address"
    )
