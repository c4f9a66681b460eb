"""Batch jobs that build the analysis tables from raw swaps, transfers and transactions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.calendar import day, starting
from tidewell.operators.ranking import number_rows


def _real_swaps(swaps: DataFrame, since: str | date | None) -> DataFrame:
    return starting(swaps, "block_timestamp", since).where(F.col("swap_from_amount") > 0)


def wallet_swap_stats(swaps: DataFrame, since: str | date | None = None) -> DataFrame:
    """Swaps and distinct assets swapped for, per wallet."""
    return _real_swaps(swaps, since).groupBy("swapper").agg(
        F.count(F.lit(1)).alias("swaps"), F.countDistinct("swap_to_asset_id").alias("swapped_for")
    )


def asset_popularity(
    swaps: DataFrame, since: str | date | None = None, by_dex: bool = False, n: int | None = None
) -> DataFrame:
    """Swaps to each asset and its rank, overall or per exchange; equal counts rank by asset id.

    With ``n`` only the first ``n`` ranks (of each exchange): the others go before any shuffle of the counts.
    """
    keys = ["swap_program"] if by_dex else []
    counts = _real_swaps(swaps, since).groupBy(
        *keys, "swap_to_asset_id", F.col("swap_to_name").alias("asset_name")
    ).agg(F.count(F.lit(1)).alias("swaps"))
    return number_rows(counts, "-swaps", "swap_to_asset_id", by=keys, top=n)


def identify_whales(accounts: DataFrame, labels: DataFrame, min_balance: float = 200_000) -> DataFrame:
    """Open, user-controlled, unlabelled wallets with at least ``min_balance``."""
    return accounts.where(
        ~F.col("account_closed") & (F.col("wallet_type") != "lsig") & (F.col("balance") >= min_balance)
    ).join(labels.select("address"), "address", "left_anti")


def whale_swaps(swaps: DataFrame, whales: DataFrame, since: str | date | None = None) -> DataFrame:
    """Swaps made by the given wallets."""
    wallets = whales.select(F.col("address").alias("swapper"))
    return starting(swaps, "block_timestamp", since).join(wallets, "swapper", "left_semi")


def _at(items: Column, position: int) -> Column:
    return F.try_element_at(items, F.lit(position))


def extract_vault_events(raw: DataFrame, vault_accounts: DataFrame, program_id: str) -> DataFrame:
    """Vault deposits and withdrawals out of nested transaction events.

    Deposit: the first inner instruction is a transfer, the first account is a vault and the
    seventh its token mint. Withdrawal: a burn, then a transfer, and the first account is a vault.
    """
    inner, accounts = F.col("inner_instructions"), F.col("accounts")
    first, second = _at(inner, 1), _at(inner, 2)
    vaults = vault_accounts.select(
        F.col("address").alias("__account"), F.col("token").alias("__mint"), "vault"
    )
    called = raw.where(F.col("program_id") == program_id).select(
        "block_timestamp",
        _at(accounts, 1).alias("__account"),
        _at(accounts, 7).alias("__seventh"),
        first["type"].alias("__first"),
        second["type"].alias("__second"),
        first["amount"].alias("__first_amount"),
        second["amount"].alias("__second_amount"),
        F.col("signer").alias("address"),
    )
    deposit = (F.col("__first") == "transfer") & (F.col("__seventh") == F.col("__mint"))
    withdrawal = F.col("__first").isin("burn", "burnr") & (F.col("__second") == "transfer")
    return (
        called.join(vaults, "__account")
        .withColumn("type", F.when(deposit, "deposit").when(withdrawal, "withdrawal"))
        .where(F.col("type").isNotNull())
        .select(
            "block_timestamp", "type", "vault",
            F.when(F.col("type") == "deposit", F.col("__first_amount"))
            .otherwise(F.col("__second_amount")).alias("amount"),
            "address",
        )
    )


def _net_stake(actions: DataFrame, *by: str) -> DataFrame:
    """Deposits less withdrawals; other actions move no stake."""
    signed = F.when(F.col("action") == "deposit", F.col("stake_units")).when(F.col("action") == "withdraw", -F.col("stake_units")).otherwise(0.0)
    return actions.groupBy(*by).agg(F.sum(signed).alias("stake"))


def ledger_balances(transfers: DataFrame, liquidity_actions: DataFrame) -> DataFrame:
    """Wallet balance (credits less debits), liquidity balance (deposits less withdrawals), and both.

    A transfer becomes a debit leg and a credit leg by one explode, so the ledger is read once.
    """
    legs = F.explode(
        F.array(
            F.struct(F.col("from_address").alias("address"), (-F.col("amount")).alias("amount")),
            F.struct(F.col("to_address").alias("address"), F.col("amount").alias("amount")),
        )
    )
    wallet = (
        transfers.select(legs.alias("leg"))
        .groupBy(F.col("leg.address").alias("address"))
        .agg(F.sum("leg.amount").alias("rune_wallet_balance"))
    )
    pooled = _net_stake(liquidity_actions, "address").withColumnRenamed("stake", "rune_lp_balance")
    same = F.col("wallet.address").eqNullSafe(F.col("pooled.address"))  # a missing address is one address
    both = wallet.alias("wallet").join(pooled.alias("pooled"), same, "full")
    zero = F.lit(0.0)
    return both.select(
        F.coalesce("wallet.address", "pooled.address").alias("address"),
        F.coalesce("rune_wallet_balance", zero).alias("rune_wallet_balance"),
        F.coalesce("rune_lp_balance", zero).alias("rune_lp_balance"),
        (F.coalesce("rune_wallet_balance", zero) + F.coalesce("rune_lp_balance", zero)).alias("rune_total_balance"),
    )


def net_lp_positions(liquidity_actions: DataFrame) -> DataFrame:
    """Stake units per wallet and pool, withdrawals taken off; may be zero or negative."""
    net = _net_stake(liquidity_actions, "address", "pool_name")
    return net.select(F.col("address").alias("wallet"), "pool_name", F.col("stake").alias("lp_position"))


def daily_pool_stats(swaps: DataFrame) -> DataFrame:
    """Fees, origin-side volume and number of swaps per day, pool and origin asset."""
    return swaps.groupBy(day("block_timestamp").alias("date"), "pool_name", "from_asset").agg(
        F.sum("fee_usd").alias("fees_usd"),
        F.sum("from_amount_usd").alias("from_amount_usd"),
        F.count(F.lit(1)).alias("swaps"),
    )
