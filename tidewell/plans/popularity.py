"""Most swapped-to assets, overall and per exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.reshape import rank_matrix, small_column

#: A table may become this wide.
MOST_COLUMNS = 200


def top_assets(popularity: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` ranks, most swaps first; ``sort_key`` keeps the order as a column."""
    return popularity.where(F.col("rank") <= n).withColumn("sort_key", -F.col("swaps")).orderBy("sort_key", "rank")


def top_assets_by_dex(
    popularity: DataFrame, n: int = 10, wide: bool = False, dexes: Sequence[str] | None = None
) -> DataFrame:
    """The first ``n`` ranks of every exchange in one job, or as a rank x exchange table of names.

    The wide form needs the exchanges as column names. Without ``dexes`` they are pulled from the data, in a job of its
    own; more than ``MOST_COLUMNS`` of them are refused.
    """
    top = popularity.where(F.col("rank") <= n)
    if not wide:
        return top.withColumn("sort_key", -F.col("swaps"))
    if dexes is None:
        dexes = small_column(popularity, "swap_program", MOST_COLUMNS)
    return rank_matrix(top, "rank", "swap_program", "asset_name", dexes)
