"""Label the values to be highlighted in a chart, and check the request against the data."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.ranking import number_rows
from tidewell.operators.reshape import left_join_null_safe, n_distinct


def focus_groups(df: DataFrame, col: str, values: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Each distinct value of ``col`` with a label.

    Named values take the first labels in order; the others cycle through the remaining labels
    in alphabetical order. Named values that are not in the data are listed too.
    """
    if len(labels) <= len(values):
        warnings.warn("needs more labels than values: the rest would have none", stacklevel=2)
    named = df.sparkSession.createDataFrame(
        [(v, labels[i] if i < len(labels) else None) for i, v in enumerate(values)], "value string, label string"
    )
    rest_labels = list(labels[len(values):]) or [None]
    others = df.select(F.col(col).alias("value")).distinct().join(named, "value", "left_anti")
    position = (F.col("__number") - 1) % len(rest_labels) + 1
    cycle = F.array(*[F.lit(x).cast("string") for x in rest_labels])
    rest = number_rows(others, "value", name="__number").select(
        "value", F.element_at(cycle, position.cast("int")).alias("label")
    )
    return named.unionByName(rest)


def unmatched_values(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    """Requested values that do not occur in the data."""
    asked = df.sparkSession.createDataFrame([(v,) for v in values], "value string").distinct()
    present = df.where(F.col(col).isin(list(values))).select(F.col(col).alias("value")).distinct()
    return asked.join(present, "value", "left_anti")


def ambiguous_ids(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """Ids that go with more than one value, with the number of values."""
    per_id = df.groupBy(id_col).agg(n_distinct(col).alias("n_values"))
    return per_id.where(F.col("n_values") > 1)


def mapping_by_id(df: DataFrame, id_col: str, col: str, groups: DataFrame) -> DataFrame:
    """Each id with its value and the value's label in ``groups`` (value, label); an id with several
    values has a row for each, which ``ambiguous_ids`` lists."""
    ids = df.select(F.col(id_col), F.col(col).alias("value")).distinct()
    return left_join_null_safe(ids, groups.select("value", "label"), ["value"])
