"""The graph of vaults that share depositors.

Deposits shrink to one row per wallet and vault, then to one *path* per wallet: its vaults in the
order of first deposit. Wallets with the same path are counted together before any pair of vaults
is formed, so pairs are made per distinct path, not per wallet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.nulls import safe_div
from tidewell.operators.reshape import left_join_null_safe


def first_deposits(events: DataFrame) -> DataFrame:
    """First deposit per wallet and vault, and its step in the wallet's order of vaults.

    Vaults first used at the same instant share a step. The minimum is combined before the
    shuffle, so a wallet with very many deposits is no burden, and the window sees at most one
    row per vault of a wallet.
    """
    firsts = (
        events.where(F.col("type") == "deposit")
        .groupBy("address", "vault")
        .agg(F.min("block_timestamp").alias("first_deposit"))
    )
    order = Window.partitionBy("address").orderBy("first_deposit")
    return firsts.withColumn("step", F.dense_rank().over(order))


def crossover_nodes(events: DataFrame) -> DataFrame:
    """Vaults with their depositors and the deposits that were a wallet's very first.

    Several deposits at a wallet's first instant all count as first, so deposits are counted per
    instant before they are reduced to the earliest one.
    """
    instants = (
        events.where(F.col("type") == "deposit")
        .groupBy("address", "vault", "block_timestamp")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    firsts = instants.groupBy("address", "vault").agg(
        F.min("block_timestamp").alias("first_deposit"), F.min_by("n", "block_timestamp").alias("n")
    )
    very_first = F.min("first_deposit").over(Window.partitionBy("address"))
    nodes = (
        firsts.withColumn("very_first", F.col("first_deposit") == very_first)
        .groupBy("vault")
        .agg(
            F.count(F.lit(1)).alias("depositors"),
            F.sum(F.when(F.col("very_first"), F.col("n")).otherwise(0)).alias("first_depositors"),
        )
    )
    # One row per vault of the product, so numbering them in one task is cheap.
    return nodes.select(
        F.row_number().over(Window.orderBy("vault")).cast("long").alias("id"),
        "vault", "depositors", "first_depositors",
    )


def _paths(events: DataFrame) -> DataFrame:
    """Distinct vault paths and the number of wallets that took each."""
    path = F.sort_array(F.collect_list(F.struct("step", "vault"))).alias("path")
    wallets = first_deposits(events).groupBy("address").agg(path)
    return wallets.groupBy("path").agg(F.count(F.lit(1)).alias("wallets"))


def directed_crossover(events: DataFrame, nodes: DataFrame, normalize_by: str = "depositors") -> DataFrame:
    """Wallets that deposited in ``from_vault`` strictly before ``to_vault``, also as a share of the origin.

    ``normalize_by`` is ``depositors`` or ``first_depositors`` of the origin.
    """
    if normalize_by not in ("depositors", "first_depositors"):
        raise ValueError(f"cannot normalize by {normalize_by!r}")
    earlier = _paths(events).select("wallets", "path", F.explode("path").alias("a"))
    later = earlier.select("wallets", "a", F.explode("path").alias("b")).where(F.col("a.step") < F.col("b.step"))
    weights = later.groupBy(F.col("a.vault").alias("from_vault"), F.col("b.vault").alias("to_vault")).agg(
        F.sum("wallets").alias("weight")
    )
    origin = nodes.select(
        F.col("vault").alias("from_vault"), F.col("id").alias("from"), F.col(normalize_by).alias("__base")
    )
    target = nodes.select(F.col("vault").alias("to_vault"), F.col("id").alias("to"))
    return left_join_null_safe(left_join_null_safe(weights, origin, ["from_vault"]), target, ["to_vault"]).select(
        "from", "to", "weight",
        safe_div(F.col("weight"), F.col("__base")).alias("percentage_weight"),
        "from_vault", "to_vault",
    )


def undirected_crossover(edges: DataFrame) -> DataFrame:
    """Both directions of a pair added up."""
    swapped = F.col("from") > F.col("to")
    low = F.when(swapped, F.col("to_vault")).otherwise(F.col("from_vault"))
    high = F.when(swapped, F.col("from_vault")).otherwise(F.col("to_vault"))
    return edges.groupBy(
        F.least("from", "to").alias("first"), F.greatest("from", "to").alias("second"),
        low.alias("vault_1"), high.alias("vault_2"),
    ).agg(F.sum("weight").alias("weight"))


def export_nodes(nodes: DataFrame, size_by: str = "depositors") -> DataFrame:
    shown = {"depositors": "Depositors", "first_depositors": "First depositors"}[size_by]
    return nodes.select(
        "id",
        (F.col("id") - 1).alias("zero_based_id"),
        F.col("vault").alias("label"),
        (F.ln(F.col(size_by).cast("double")) * 3).alias("size"),
        F.concat(F.col("vault"), F.lit(f" vault, {shown}: "), F.col(size_by).cast("string")).alias("title"),
    )


def export_edges(edges: DataFrame) -> DataFrame:
    """Directed edges for drawing: widths, zero-based ends and shares in percent."""
    return edges.select(
        "from", "to",
        (F.col("from") - 1).alias("source"),
        (F.col("to") - 1).alias("target"),
        (F.col("weight") / 30).alias("width"),
        (F.col("percentage_weight") * 100).alias("percentage"),
        F.concat(F.col("from_vault"), F.lit(" to "), F.col("to_vault"), F.lit(": "), F.col("weight").cast("string"))
        .alias("title"),
    )


def graph_export(nodes: DataFrame, edges: DataFrame, size_by: str = "depositors") -> tuple[DataFrame, DataFrame]:
    return export_nodes(nodes, size_by), export_edges(edges)
