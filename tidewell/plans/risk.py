"""Market index, drawdowns and downside-risk tables. One row per coin and day in, windows per coin."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewell.functions.calendar import day, month_floor, starting
from tidewell.functions.names import coin_alias
from tidewell.functions.nulls import running_max_strict, safe_div, sum_strict
from tidewell.operators import stats
from tidewell.operators.distribution import running_counts, value_counts
from tidewell.operators.reshape import left_join_null_safe
from tidewell.operators.series import worst_fall


def _series() -> WindowSpec:
    return Window.partitionBy("coin_id").orderBy("timestamp")


def clean_prices(prices: DataFrame, start: str | date | None = None, end: str | date | None = None) -> DataFrame:
    """One close per day, report spelling of the coins, and the study window.

    Of several quotes of a coin and day the last one counts.
    """
    others = [c for c in prices.columns if c not in ("coin_id", "timestamp")]
    closes = prices.groupBy(
        coin_alias(F.col("coin_id")).alias("coin_id"), day("timestamp").cast("timestamp_ntz").alias("__day")
    ).agg(F.max_by(F.struct(*others), "timestamp").alias("__last"))
    daily = closes.select("coin_id", F.col("__day").alias("timestamp"), "__last.*").select(*prices.columns)
    return starting(daily, "timestamp", start, end)


def market_cap_index(prices: DataFrame, base: float = 100.0) -> DataFrame:
    """Total market cap relative to its first day, in the shape of a coin.

    The first day's value is looked up with ``min_by`` on the daily totals instead of an ordered
    window over them.
    """
    totals = prices.groupBy("timestamp").agg(sum_strict("market_cap").alias("market_cap"))
    first = totals.agg(F.min_by("market_cap", "timestamp")).scalar()
    return totals.select(
        F.lit("index").alias("coin_id"),
        "timestamp",
        F.lit("usd").alias("vs_currency"),
        (safe_div(F.col("market_cap"), first) * base).alias("price"),
        F.lit(None).cast("double").alias("total_volume"),
        "market_cap",
    )


def normalize_and_drawdown(
    prices: DataFrame, start: str | date | None = None, end: str | date | None = None
) -> DataFrame:
    """Coins and index, each from 100, with running maximum and drawdown."""
    window = clean_prices(prices, start, end)
    both = window.unionByName(market_cap_index(window), allowMissingColumns=True)
    return (
        both.withColumn("price", safe_div(F.col("price"), F.first("price").over(_series())) * 100)
        .withColumn("cum_max", running_max_strict(F.col("price"), _series()))
        .withColumn("drawdown", safe_div(F.col("price"), F.col("cum_max")) - 1)
    )


def rolling_drawdown(normalized: DataFrame, rows: int = 30) -> DataFrame:
    """Fall from the highest of the last ``rows`` rows; the frame is shorter at the start by itself."""
    trailing = _series().rowsBetween(-(rows - 1), Window.currentRow)
    return normalized.withColumn("rolling_max", F.max("price").over(trailing)).withColumn(
        "rolling_drawdown", safe_div(F.col("price"), F.col("rolling_max")) - 1
    )


def monthly_max_drawdown(normalized: DataFrame) -> DataFrame:
    """Deepest fall within each month, on every row of the month."""
    month = Window.partitionBy("coin_id", "month_date")
    return (
        normalized.withColumn("month_date", month_floor("timestamp"))
        .withColumn("month_cum_max", running_max_strict(F.col("price"), month.orderBy("timestamp")))
        .withColumn("month_drawdown", safe_div(F.col("price"), F.col("month_cum_max")) - 1)
        .withColumn("month_max_drawdown", F.min("month_drawdown").over(month))
    )


def _daily_returns(prices: DataFrame, name: str) -> DataFrame:
    """Change from one daily close to the next; a series starts with 0."""
    closes = prices.groupBy("coin_id", day("timestamp").alias("timestamp")).agg(
        F.max_by("price", "timestamp").alias("price")
    )
    change = safe_div(F.col("price"), F.lag("price").over(_series())) - 1
    start = F.row_number().over(_series()) == 1
    return closes.withColumn(name, F.when(start, F.lit(0.0)).otherwise(change)).drop("price")


def returns_vs_benchmark(prices: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Daily returns of every coin and of the index (``ra``) beside the index's return (``rb``)."""
    index = market_cap_index(prices) if index is None else index
    cols = ["coin_id", "timestamp", "price"]
    ra = _daily_returns(prices.select(cols).unionByName(index.select(cols)), "ra")
    rb = _daily_returns(index.select(cols), "rb").drop("coin_id")
    return left_join_null_safe(ra, rb, ["timestamp"]).select("timestamp", "coin_id", "ra", "rb")


def max_drawdown(returns: DataFrame) -> DataFrame:
    """Largest fall of the compounded return series, as a positive share; wealth starts at 1.

    Years are summed up first and merged, so that a long series is not one task.
    """
    moved = returns.withColumn("__factor", 1 + F.col("ra"))
    falls = worst_fall(moved, ["coin_id"], ["timestamp"], "__factor", F.date_trunc("year", "timestamp"))
    return falls.withColumnRenamed("fall", "maximum_drawdown")


def downside_risk_table(returns: DataFrame, p: float = 0.95) -> DataFrame:
    """Three measures in one aggregation per coin, and the largest fall."""
    ra = F.col("ra")
    measures = returns.where(ra.isNotNull()).groupBy("coin_id").agg(
        stats.downside_deviation(ra).alias("downside_deviation"),
        stats.historical_var(ra, p).alias("historical_var"),
        stats.modified_var(ra).alias("modified_var"),
    )
    return left_join_null_safe(measures, max_drawdown(returns), ["coin_id"])


def capm_table(returns: DataFrame) -> DataFrame:
    """Beta on all, falling and rising benchmark days, and correlation: one pass."""
    ra, rb = F.col("ra"), F.col("rb")
    return returns.groupBy("coin_id").agg(
        stats.beta(ra, rb).alias("beta"),
        stats.beta(ra, rb, "down").alias("beta_down"),
        stats.beta(ra, rb, "up").alias("beta_up"),
        stats.corr_side(ra, rb).alias("correlation"),
    )


def side_correlations(returns: DataFrame) -> DataFrame:
    ra, rb = F.col("ra"), F.col("rb")
    return returns.groupBy("coin_id").agg(
        stats.corr_side(ra, rb, "down").alias("corr_down"),
        stats.corr_side(ra, rb, "not_down").alias("corr_up"),
    )


def _threshold(pairs: DataFrame, c: str, u: float) -> DataFrame:
    """The floor(n u)-th order statistic per coin, out of running counts; no coin is sorted in one task."""
    steps = running_counts(value_counts(pairs, c, ["coin_id"]), c, ["coin_id"])
    cut = F.floor(F.col("n_total") * u)
    holds = (F.col("n_through") >= cut) & (F.col("n_through") - F.col("n") < cut)
    return steps.where(holds).select("coin_id", F.col(c).alias(f"__above_{c}"))


def tail_dependence_table(returns: DataFrame, u: float = 0.8, kind: str = "chi") -> DataFrame:
    """How often coin and benchmark are in their upper tails together.

    The threshold of each series is its floor(n u)-th order statistic.
    """
    pairs = returns.where(F.col("ra").isNotNull() & F.col("rb").isNotNull())
    thresholds = left_join_null_safe(_threshold(pairs, "ra", u), _threshold(pairs, "rb", u), ["coin_id"])
    both = (F.col("ra") > F.col("__above_ra")) & (F.col("rb") > F.col("__above_rb"))
    joint = (
        left_join_null_safe(pairs, thresholds, ["coin_id"])
        .groupBy("coin_id")
        .agg(F.count_if(both).alias("joint"), F.count(F.lit(1)).alias("n"))
    )
    if kind == "chi":
        return joint.select("coin_id", safe_div(F.col("joint"), F.col("n") * (1 - u)).alias("tail_dependence"))
    # ln(0) is NULL in Spark, which is also the answer here: nothing was ever in both tails.
    log_joint = F.ln(safe_div(F.col("joint"), F.col("n")))
    return joint.select("coin_id", (safe_div(2 * F.ln(F.lit(1 - u)), log_joint) - 1).alias("tail_dependence"))
