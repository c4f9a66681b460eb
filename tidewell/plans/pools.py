"""Daily pool statistics: canonical assets, days since inception, origin shares."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.calendar import day, starting
from tidewell.functions.names import canonical_asset
from tidewell.functions.nulls import safe_div, sum_strict
from tidewell.operators.reshape import left_join_null_safe

MEASURES = ("fees_usd", "from_amount_usd", "swaps")


def _sums() -> list:
    return [sum_strict(m).alias(m) for m in MEASURES]


def canonical_pool_swaps(raw: DataFrame) -> DataFrame:
    """Synthetic assets merged into their native ones, per day and pool."""
    return (
        raw.withColumn("from_asset", canonical_asset(F.col("from_asset")))
        .groupBy("date", "from_asset", "pool_name")
        .agg(*_sums())
    )


def since_inception(pool_daily: DataFrame, pools: Sequence[str] | None = None, max_day: int = 3) -> DataFrame:
    """Pools laid over each other by their own first day, for the first ``max_day`` days."""
    chosen = pool_daily if pools is None else pool_daily.where(F.col("pool_name").isin(list(pools)))
    start = chosen.groupBy("pool_name").agg(F.min(day("date")).alias("date_reference"))
    return (
        left_join_null_safe(chosen, start, ["pool_name"])
        .withColumn("date", day("date"))
        .withColumn("day", F.datediff("date", "date_reference"))
        .where(F.col("day") <= max_day)
        .groupBy("date", "date_reference", "day", "pool_name")
        .agg(*_sums())
    )


def pool_summary(pool_daily: DataFrame, since: str | date | None = None) -> DataFrame:
    return starting(pool_daily, "date", since).groupBy("date", "pool_name").agg(*_sums())


def origination_share(
    pool_daily: DataFrame, pool: str | None = None, measure: str = "from_amount_usd"
) -> DataFrame:
    """Each origin asset's part of a pool's day, by volume or by number of swaps; ``None`` does every pool."""
    chosen = pool_daily if pool is None else pool_daily.where(F.col("pool_name") == pool)
    # a pool's day has a handful of origin assets
    total = F.sum(measure).over(Window.partitionBy("date", "pool_name"))
    known = F.count(measure).over(Window.partitionBy("date", "pool_name")) == F.count(F.lit(1)).over(Window.partitionBy("date", "pool_name"))
    shares = chosen.withColumn("share", safe_div(F.col(measure), F.when(known, total)))
    return shares.select("date", "pool_name", "from_asset", measure, "share")
