"""Expressions with strict NULL semantics.

The analyses treat a missing value as contagious: a sum, a running total or a minimum that
touches one is itself missing. Spark's own aggregates skip NULL, so these helpers add the check.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def sum_strict(c: Column | str) -> Column:
    """Sum that is NULL as soon as one input is NULL (partial aggregation still applies)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def _running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _if_complete(c: Column, value: Column, w: WindowSpec) -> Column:
    return F.when(F.count(c).over(w) == F.count(F.lit(1)).over(w), value)


def running_sum_strict(c: Column, w: WindowSpec) -> Column:
    """Cumulative sum; every row after a NULL is NULL."""
    w = _running(w)
    return _if_complete(c, F.sum(c).over(w), w)


def running_max_strict(c: Column, w: WindowSpec) -> Column:
    """Cumulative maximum; every row after a NULL is NULL."""
    w = _running(w)
    return _if_complete(c, F.max(c).over(w), w)


def lagged_product_strict(c: Column, w: WindowSpec, default: float = 1.0) -> Column:
    """Cumulative product of the *preceding* rows, ``default`` where it is missing."""
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(_if_complete(c, F.product(c).over(before), before), F.lit(default))


def _all_present(cols: tuple[Column, ...]) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])


def least_strict(*cols: Column) -> Column:
    return F.when(_all_present(cols), F.least(*cols))


def greatest_strict(*cols: Column) -> Column:
    return F.when(_all_present(cols), F.greatest(*cols))


def if_else(cond: Column, yes, no) -> Column:
    """Two-way choice that stays NULL when the condition is NULL."""
    return F.when(cond, yes).when(~cond, no)


def safe_div(a: Column, b: Column) -> Column:
    """Division with NULL for a zero divisor (ANSI mode would raise)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))
