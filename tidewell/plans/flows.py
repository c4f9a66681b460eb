"""Vault deposits and withdrawals: valued flows, running totals, new depositors.

Raw events are only ever aggregated; windows run over days or weeks per vault.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.calendar import FRIDAY, day, week_floor
from tidewell.functions.nulls import if_else, running_sum_strict, safe_div, sum_strict
from tidewell.operators.reshape import count_distribution, ffill, left_join_null_safe, to_long


def attribute_price_day(rates: DataFrame, tokens: DataFrame, as_of: str | date) -> DataFrame:
    """A quote stamped at midnight belongs to the day it closes; add the token symbol.

    Quotes later than ``as_of`` are live prices and keep their own day.
    """
    closed = F.col("timestamp") <= F.lit(as_of).cast("timestamp_ntz")
    shifted = F.when(closed, F.col("timestamp") - F.expr("INTERVAL 1 SECOND")).otherwise(F.col("timestamp"))
    dated = rates.withColumn("timestamp", shifted).withColumn("date", day("timestamp"))
    return left_join_null_safe(dated, tokens, ["coin_id"])


def daily_valued_flows(events: DataFrame, rates: DataFrame, mode: str = "event_days") -> DataFrame:
    """Amounts per day, type and vault in units and USD at the day's or last known price.

    ``event_days`` fills a missing price from the previous day *with events* of the same type
    and vault. ``asof`` takes the latest quote on or before the day: quotes are spread over the
    days up to the next quote first, so it is still an equi-join.
    """
    daily = events.groupBy(day("block_timestamp").alias("date"), "type", "vault").agg(
        F.count(F.lit(1)).alias("events"), sum_strict("amount").alias("amount")
    )
    quotes = rates.select(F.col("token").alias("vault"), "date", "coin_id", "price")
    if mode == "asof":
        quotes = quotes.where(F.col("price").isNotNull())
        last = daily.agg(F.max("date")).scalar()
        following = F.lead("date").over(Window.partitionBy("vault").orderBy("date"))
        until = F.coalesce(F.date_sub(following, 1), F.greatest(last, F.col("date")))
        quotes = quotes.withColumn("__until", until).withColumn(
            "date", F.explode(F.sequence(F.col("date"), F.col("__until")))
        )
        valued = left_join_null_safe(daily, quotes.drop("__until"), ["vault", "date"])
    elif mode == "event_days":
        valued = ffill(
            left_join_null_safe(daily, quotes, ["vault", "date"]), ["type", "vault"], ["date"], ["coin_id", "price"]
        )
    else:
        raise ValueError(f"mode must be event_days or asof, not {mode!r}")
    return valued.select(
        "date", "type", "vault", "events", "amount", (F.col("amount") * F.col("price")).alias("amount_usd")
    )


def weekly_net_flows(daily: DataFrame, week_start: int = FRIDAY) -> DataFrame:
    """Net deposits per week and vault, and their running totals."""
    out = F.col("type") == "withdrawal"
    weekly = daily.groupBy(week_floor("date", week_start).alias("week"), "vault").agg(
        sum_strict(if_else(out, -F.col("amount"), F.col("amount"))).alias("net_deposits"),
        sum_strict(if_else(out, -F.col("amount_usd"), F.col("amount_usd"))).alias("net_deposits_usd"),
    )
    w = Window.partitionBy("vault").orderBy("week")
    return weekly.withColumns(
        {
            "deposits_to_date": running_sum_strict(F.col("net_deposits"), w),
            "deposits_usd_to_date": running_sum_strict(F.col("net_deposits_usd"), w),
        }
    )


def cumulative_vs_benchmark(weekly: DataFrame, week: str | date) -> DataFrame:
    """Running USD total beside its level at ``week``, long form; no level before that week."""
    marked = weekly.select(
        "week", "vault",
        F.col("deposits_usd_to_date").alias("value"),
        F.when(F.col("week") == F.lit(week).cast("date"), F.col("deposits_usd_to_date")).alias("benchmark"),
    )
    filled = ffill(marked, ["vault"], ["week"], ["benchmark"])
    return to_long(filled, ["week", "vault"], ["value", "benchmark"], "type", "usd")


def net_flows_since(weekly: DataFrame, week: str | date) -> DataFrame:
    return weekly.where(F.col("week") >= F.lit(week).cast("date")).select("week", "vault", "net_deposits_usd")


def weekly_new_users(events: DataFrame, week_start: int = FRIDAY, na_include: bool = True) -> DataFrame:
    """Distinct depositors to date and first-time depositors, per vault and week with deposits.

    A depositor counts once, in the week of the first deposit: a minimum per (vault, address),
    then a count per week, then a running sum over weeks. A week whose depositors were all known
    already stays, with 0.
    """
    deposits = events.where(F.col("type") == "deposit").withColumn("week", week_floor("block_timestamp", week_start))
    known = deposits if na_include else deposits.where(F.col("address").isNotNull())
    first = known.groupBy("vault", "address").agg(F.min("week").alias("week"))
    joined = first.groupBy("vault", "week").agg(F.count(F.lit(1)).alias("__new"))
    active = deposits.select("vault", "week").distinct()
    w = Window.partitionBy("vault").orderBy("week")
    return left_join_null_safe(active, joined, ["vault", "week"]).select(
        "vault", "week",
        F.sum(F.coalesce("__new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("distinct_users"),
        F.coalesce("__new", F.lit(0)).alias("new_users"),
    )


def new_users_since(users: DataFrame, week: str | date) -> DataFrame:
    """Counting restarts at the cut-off week."""
    w = Window.partitionBy("vault").orderBy("week")
    kept = users.where(F.col("week") >= F.lit(week).cast("date"))
    return kept.select(
        "vault", "week", "new_users", running_sum_strict(F.col("new_users"), w).alias("cumulative_new_users")
    )


def vaults_per_wallet(events: DataFrame) -> DataFrame:
    """Number of wallets by the number of vaults they used, any kind of event."""
    counts = count_distribution(events, "address", "vault", "vaults")
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("percentage", safe_div(F.col("n"), total))
