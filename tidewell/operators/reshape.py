"""Reshaping: long/wide, complete grids, carrying values forward, shares and focus labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.nulls import safe_div, sum_strict


def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(cols), name, value)


def null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition under which a missing key matches a missing key."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` with NULL matching NULL; key columns come out once, from the left."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(renamed[f"__r_{k}"])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def left_join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left equi-join on ``keys`` with NULL matching NULL; key columns come out once."""
    return join_null_safe(left, right, keys, "left")


def calendar_of(df: DataFrame, period: str) -> DataFrame:
    """The distinct days or weeks of ``df``, each with its ordinal from 1 on.

    Calendar periods are few (a century of days is 36,525), whatever the number of rows, so they are
    numbered in one task.
    """
    days = df.where(F.col(period).isNotNull()).select(F.col(period).alias("__day")).distinct()
    return days.withColumn("__at", F.row_number().over(Window.orderBy("__day")))


def complete_grid(df: DataFrame, period: str, key: str, cols: Sequence[str] = ()) -> DataFrame:
    """Every observed ``period`` next to every observed ``key``, with ``cols`` where there is a row.

    A missing period or key is one of its kind, and a repeated pair gives a row for each. The distinct
    periods (calendar length) are exploded over the distinct keys; the rows join that grid on both.
    """
    known = F.sort_array(F.collect_set(period))
    missing = F.when(F.count_if(F.col(period).isNull()) > 0, F.array(F.lit(None).cast(df.schema[period].dataType)))
    periods = df.agg(F.concat(known, F.coalesce(missing, F.array().cast(f"array<{df.schema[period].dataType.simpleString()}>")))).scalar()
    grid = df.select(key).distinct().withColumn(period, F.explode(periods))
    return left_join_null_safe(grid, df.select(period, key, *cols), [period, key]).select(period, key, *cols)


def ffill(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Last known value of each column within ``keys``. For series of calendar length per key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def carry_to_next(df: DataFrame, key: str, day: str) -> DataFrame:
    """Repeat each row on every observed day up to the key's next row.

    The outcome equals joining a full day x key grid, filling down and dropping the days before
    a key's first row, but neither the grid nor the dropped part is ever built: a row's span is
    known from its successor alone, and the work is in proportion to the rows that come out. Of
    several rows of a key and day all stay on that day and one is carried on; a row without a day
    stays as it is. Days are ordinals in between, looked up in a table of one row per day.
    """
    calendar = calendar_of(df, day)
    placed = df.join(calendar.withColumnRenamed("__day", "__own"), F.col(day) == F.col("__own"), "left").drop("__own")
    successor = F.lead("__at").over(Window.partitionBy(key).orderBy(F.asc_nulls_last("__at")))
    last = calendar.agg(F.max("__at")).scalar()
    until = F.greatest(F.coalesce(successor, last + 1) - 1, F.col("__at"))
    spans = F.when(F.col("__at").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence("__at", "__until"))
    repeated = placed.withColumn("__until", until).withColumn("__at", F.explode(spans)).drop("__until")
    return repeated.join(calendar, "__at", "left").withColumn(day, F.col("__day")).drop("__at", "__day")


def small_column(df: DataFrame, col: str, most: int) -> list:
    """The distinct non-missing values of a column, ascending, on the driver; an error if there are more than ``most``."""
    values = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{col} has more than {most} values")
    return sorted(values)


def rank_matrix(df: DataFrame, rank: str, col: str, value: str, values: Sequence[str]) -> DataFrame:
    """Wide table: one row per rank, one column per listed value of ``col``."""
    return df.groupBy(rank).pivot(col, list(values)).agg(F.first(value, ignorenulls=True))


def share_of(df: DataFrame, measure: str, by: Sequence[str] = (), name: str = "share") -> DataFrame:
    """Each row's part of its group's total, or of the grand total.

    The total is a partial aggregate joined back, so a group holding most of the rows does not
    end up in a single task as it would in a partition-wide window.
    """
    if not by:
        total = df.agg(sum_strict(measure)).scalar()
        return df.withColumn(name, safe_div(F.col(measure), total))
    totals = df.groupBy(*by).agg(sum_strict(measure).alias("__total"))
    joined = left_join_null_safe(df, totals, by)
    return joined.withColumn(name, safe_div(F.col(measure), F.col("__total"))).drop("__total")


def n_distinct(c: str) -> Column:
    """Number of distinct values, a missing one being a value too."""
    return F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))


def count_distribution(df: DataFrame, entity: str, counted: str, name: str) -> DataFrame:
    """How many entities have 1, 2, ... distinct ``counted`` values."""
    per_entity = df.groupBy(entity).agg(n_distinct(counted).alias(name))
    return per_entity.groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def top_with_ties(df: DataFrame, measure: str, n: int) -> DataFrame:
    """The ``n`` largest rows plus all rows tied with the last of them.

    The n-th value is found with a bounded top-k and used as a threshold, which avoids a rank
    window over the whole table.
    """
    best = df.select(measure).where(F.col(measure).isNotNull()).orderBy(F.desc(measure)).limit(n)
    return df.where(F.col(measure) >= best.agg(F.min(measure)).scalar())
