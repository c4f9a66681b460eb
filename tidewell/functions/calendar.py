"""Calendar buckets built from date arithmetic, so they do not depend on the session time zone."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRIDAY = 5  # ISO day numbers, Monday = 1
SUNDAY = 7

# 1970-01-05 was a Monday.
_FIRST_MONDAY = date(1970, 1, 5)


def day(ts: Column | str) -> Column:
    return F.to_date(ts)


def week_floor(ts: Column | str, start: int = FRIDAY) -> Column:
    """Date of the latest ``start`` weekday on or before ``ts``."""
    d = F.to_date(ts)
    past = F.pmod(F.datediff(d, F.lit(_FIRST_MONDAY)) - F.lit(start - 1), F.lit(7))
    return F.date_sub(d, past)


def week_ceiling(ts: Column | str, start: int = SUNDAY) -> Column:
    """Date of the next ``start`` weekday; a timestamp exactly on that midnight stays there."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    floor = week_floor(ts, start)
    on_boundary = ts.cast("timestamp_ntz") == floor.cast("timestamp_ntz")
    return F.when(on_boundary, floor).otherwise(F.date_add(floor, 7))


def month_floor(ts: Column | str) -> Column:
    return F.to_date(F.trunc(F.to_date(ts), "month"))


def starting(df: DataFrame, ts: str, first: str | date | None, last: str | date | None = None) -> DataFrame:
    """Rows from midnight of ``first`` through midnight of ``last`` (both optional, UTC)."""
    if first is not None:
        df = df.where(F.col(ts) >= F.lit(first).cast("timestamp_ntz"))
    if last is not None:
        df = df.where(F.col(ts) <= F.lit(last).cast("timestamp_ntz"))
    return df


def since(df: DataFrame, ts: str, as_of: str | date, days: int = 364) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``; the run date is a parameter."""
    first = F.date_sub(F.lit(as_of).cast("date"), days)
    return df.where(F.col(ts) >= first.cast("timestamp_ntz"))
