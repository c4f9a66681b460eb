"""Price levels and the weekly covered-call back-test.

Input is a price history of one row per coin and day. Every series window is partitioned by
coin, so a partition is as long as the calendar, and all coins run side by side.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewell.functions.calendar import FRIDAY, starting, week_floor
from tidewell.functions.nulls import if_else, lagged_product_strict, least_strict, safe_div, sum_strict
from tidewell.operators.reshape import left_join_null_safe, to_long


def _series() -> WindowSpec:
    return Window.partitionBy("coin_id").orderBy("timestamp")


def level_days(prices: DataFrame, level: float, since: str | date | None = None) -> DataFrame:
    """Days in all, days at or above ``level`` and days below, per coin."""
    above = F.col("price") >= level
    return (
        starting(prices, "timestamp", since)
        .groupBy("coin_id")
        .agg(
            F.count(F.lit(1)).alias("days"),
            sum_strict(if_else(above, F.lit(1), F.lit(0))).alias("days_above"),
            sum_strict(if_else(above, F.lit(0), F.lit(1))).alias("days_below"),
        )
    )


def price_window(prices: DataFrame, since: str | date) -> DataFrame:
    return starting(prices, "timestamp", since).select("coin_id", "timestamp", "price").orderBy("coin_id", "timestamp")


def _with_week_open(prices: DataFrame, week_start: int = FRIDAY) -> DataFrame:
    """Add the week and the price just before it (``open``): the price the week's option is struck on."""
    previous = F.coalesce(F.lag("price").over(_series()), F.col("price"))
    return (
        prices.select("coin_id", "timestamp", "price")
        .withColumn("prev", previous)
        .withColumn("week", week_floor("timestamp", week_start))
        .withColumn("open", F.first("prev").over(Window.partitionBy("coin_id", "week").orderBy("timestamp")))
    )


def strikes(prices: DataFrame, mult: float = 1.15, week_start: int = FRIDAY) -> DataFrame:
    """Simulated strike per day: the week's opening price times ``mult``, to the nearest half."""
    # Ties go to the even unit, so this is bround and not round.
    strike = F.bround(F.col("open") * mult * 2, 0) / 2
    return (
        _with_week_open(prices, week_start)
        .withColumn("simulated_strike", strike)
        .withColumn("breakeven", safe_div(F.col("simulated_strike"), F.col("price")) - 1)
        .drop("open")
    )


def weekly_strikes(
    prices: DataFrame, mult: float = 1.15, week_start: int = FRIDAY, since: str | date | None = None
) -> DataFrame:
    """Price and strike in long form. The cut comes last: the first shown week needs its history."""
    long = to_long(
        strikes(prices, mult, week_start),
        ["coin_id", "timestamp", "week", "breakeven"],
        ["price", "simulated_strike"],
        "type",
        "value",
    )
    return starting(long, "timestamp", since)


def strike_breaches(prices: DataFrame, mult: float = 1.15) -> DataFrame:
    """Weeks in all, and weeks that closed above their strike."""
    weekly = (
        strikes(prices, mult)
        .groupBy("coin_id", "week")
        .agg(F.max_by("breakeven", "timestamp").alias("breakeven"))
    )
    below = if_else(F.col("breakeven") < 0, F.lit(1), F.lit(0))
    return weekly.groupBy("coin_id").agg(
        F.count(F.lit(1)).alias("weeks"),
        sum_strict(below).alias("breaches"),
    )


def _capped_return(mult: float) -> Column:
    """Return since the week's opening price, capped where the call is exercised."""
    return least_strict(safe_div(F.col("price"), F.col("open")) - 1, F.lit(mult - 1))


def premium_portfolios(
    prices: DataFrame, mult: float, premiums: Sequence[float]
) -> DataFrame:
    """Value of a covered-call portfolio for each weekly premium, next to buying and holding.

    Each premium is one element of an array carried by the row, so any number of them is one
    pass over the prices. Levels restart nothing between weeks: a week begins at the product of
    all earlier weeks' closing multipliers, a series of one row per coin, premium and week.
    """
    daily = (
        _with_week_open(prices)
        .withColumn("hold_portfolio", 100 * safe_div(F.col("price"), F.first("price").over(_series())))
        .withColumn("premium", F.explode(F.array(*[F.lit(float(p)) for p in premiums])))
        .withColumn("covered_call_returns", _capped_return(mult) + F.col("premium"))
    )
    weekly = daily.groupBy("coin_id", "premium", "week").agg(
        (F.max_by("covered_call_returns", "timestamp") + 1).alias("multiplier")
    )
    order = Window.partitionBy("coin_id", "premium").orderBy("week")
    levels = weekly.withColumn("level", lagged_product_strict(F.col("multiplier"), order)).drop("multiplier")
    return left_join_null_safe(daily, levels, ["coin_id", "premium", "week"]).select(
        "coin_id", "timestamp", "week", "premium", "covered_call_returns",
        (100 * F.col("level") * (1 + F.col("covered_call_returns"))).alias("covered_call_portfolio"),
        "hold_portfolio",
    )


def covered_call_portfolio(
    prices: DataFrame, mult: float = 1.15, premium: float = 0.0, since: str | date | None = None
) -> DataFrame:
    """One premium. ``since`` cuts before the simulation: the portfolio is set up on that day."""
    return premium_portfolios(starting(prices, "timestamp", since), mult, [premium]).drop("premium")


def portfolio_summary(portfolio: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Total returns, the weeks the calls cost more than they earned, and the premium that would break even.

    Without a premium both returns of a week below the cap are one number reached by different
    roundings; a ``tolerance`` above these roundings keeps such weeks from being counted.
    """
    weekly = portfolio.groupBy("coin_id", "week").agg(
        F.max_by("hold_portfolio", "timestamp").alias("hold"),
        F.max_by("covered_call_portfolio", "timestamp").alias("covered"),
    )
    order = Window.partitionBy("coin_id").orderBy("week")
    gross = {
        "hold_gross": safe_div(F.col("hold"), F.lag("hold", 1, 100.0).over(order)),
        "covered_gross": safe_div(F.col("covered"), F.lag("covered", 1, 100.0).over(order)),
    }
    behind = F.col("hold_gross") - F.col("covered_gross") > tolerance
    totals = (
        weekly.withColumns(gross)
        .withColumn("behind", if_else(behind, F.lit(1), F.lit(0)))
        .withColumn("shortfall", F.col("behind") * (F.col("covered_gross") - F.col("hold_gross")))
        .groupBy("coin_id")
        .agg(
            F.count(F.lit(1)).alias("weeks"),
            (F.max_by("hold", "week") / 100 - 1).alias("hold_return"),
            (F.max_by("covered", "week") / 100 - 1).alias("covered_call_return"),
            sum_strict("behind").alias("weeks_behind"),
            sum_strict("shortfall").alias("__shortfall"),
        )
    )
    growth = safe_div(1 + F.col("hold_return"), 1 + F.col("covered_call_return"))
    return totals.select(
        "coin_id", "weeks", "hold_return", "covered_call_return", "weeks_behind",
        safe_div(F.col("__shortfall"), F.col("weeks_behind")).alias("average_shortfall"),
        (F.pow(growth, 1 / F.col("weeks")) - 1).alias("breakeven_yield"),
    )


def percent_label(share: float) -> str:
    """A share in percent, exactly as written, with at least two decimals."""
    exact = (Decimal(repr(share)) * 100).normalize()
    return f"{exact:f}" if -exact.as_tuple().exponent > 2 else f"{exact:.2f}"


def premium_sensitivity(
    prices: DataFrame, premiums: Sequence[float] = (0.005, 0.02), mult: float = 1.15,
    since: str | date | None = None,
) -> DataFrame:
    """Long form: one line per premium and one for holding."""
    premiums = list(dict.fromkeys(map(float, premiums)))
    runs = premium_portfolios(starting(prices, "timestamp", since), mult, premiums)
    # every premium has a label of its own: its shortest exact decimal, in percent with at least two digits
    names = {p: percent_label(p) for p in premiums}
    label = F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.col("premium"))
    label = F.concat(F.lit("covered_call_"), label, F.lit("pct"))
    covered = F.struct(label.alias("portfolio"), F.col("covered_call_portfolio").alias("value"))
    hold = F.struct(F.lit("hold").alias("portfolio"), F.col("hold_portfolio").alias("value"))
    # Holding is the same beside every premium: one of them brings it along.
    lines = F.when(F.col("premium") == float(premiums[0]), F.array(covered, hold)).otherwise(F.array(covered))
    return runs.select("coin_id", "timestamp", F.explode(lines).alias("line")).select(
        "coin_id", "timestamp", "line.portfolio", "line.value"
    )


def rolling_return(
    prices: DataFrame, lag: int = 6, since: str | date | None = None, threshold: float = 0.15
) -> DataFrame:
    """Return over ``lag`` rows, computed before the cut, with the threshold line next to it."""
    out = prices.select(
        "coin_id", "timestamp",
        (safe_div(F.col("price"), F.lag("price", lag).over(_series())) - 1).alias("rolling_return"),
        F.lit(threshold).alias("threshold"),
    )
    return starting(out, "timestamp", since)


def strike_segments(long_strikes: DataFrame) -> DataFrame:
    """Horizontal chart segments at the strike, from the previous point to the present one."""
    shown = long_strikes.where(F.col("type") == "simulated_strike")
    return shown.select(
        "coin_id",
        F.lag("timestamp").over(_series()).alias("x"),
        F.col("timestamp").alias("x_end"),
        F.col("value").alias("y"),
    )
