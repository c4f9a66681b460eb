"""Risk statistics as aggregate expressions, for use in one ``groupBy(...).agg(...)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.nulls import safe_div

# Fixed value: 5 % quantile of the standard normal distribution.
Z_05 = -1.6448536269514726


def historical_var(r: Column, p: float = 0.95) -> Column:
    """Lower-tail quantile of the returns with its own sign (a loss is negative).

    Exact and interpolated. A group is one asset's daily returns, so it is of calendar length;
    for unbounded groups use ``distribution.quantiles``.
    """
    return F.percentile(r, round(1 - p, 12))


def modified_var(r: Column, z: float = Z_05) -> Column:
    """Cornish-Fisher quantile from population moments."""
    s, k = F.skewness(r), F.kurtosis(r)
    shift = (
        z + (z**2 - 1) / 6 * s + (z**3 - 3 * z) / 24 * k - (2 * z**3 - 5 * z) / 36 * s * s
    )
    return F.avg(r) + F.stddev_pop(r) * shift


def downside_deviation(r: Column, mar: float = 0.0) -> Column:
    """Root mean square shortfall below ``mar`` over all observations."""
    short = F.when(r < mar, r - mar).when(r >= mar, F.lit(0.0))
    return F.sqrt(F.avg(short * short))


def _on_side(x: Column, rb: Column, side: str) -> Column:
    keep = {
        "all": rb.isNotNull(),
        "up": rb > 0,
        "down": rb < 0,
        "not_down": rb >= 0,
    }[side]
    return F.when(keep, x)


def beta(ra: Column, rb: Column, side: str = "all") -> Column:
    """Slope of the asset's return on the benchmark's, on all, only up or only down days."""
    a, b = _on_side(ra, rb, side), _on_side(rb, rb, side)
    return F.regr_slope(a, b)


def corr_side(ra: Column, rb: Column, side: str = "all") -> Column:
    """Pearson correlation on one side of the benchmark; NULL where a side does not vary."""
    a, b = _on_side(ra, rb, side), _on_side(rb, rb, side)
    n = F.regr_count(a, b)
    # covariance over the two deviations: a constant side gives NULL instead of an error
    return F.when(n > 1, safe_div(F.covar_pop(a, b), F.sqrt(F.regr_sxx(a, b) / n * (F.regr_syy(a, b) / n))))
