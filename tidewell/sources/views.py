"""Domain views over the benchmark tables.

Every view is built by Spark from whole tables. Modulo expressions only choose labels; no view
drops rows by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.calendar import day
from tidewell.functions.names import TOKEN_ROWS
from tidewell.sources.io import dim

# Columns of the benchmark tables the views read. Declaring them saves reading a footer per table.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "labels": "doc_id bigint, quality int, toxic int",
}

VAULTS = [token for _, token in TOKEN_ROWS]


def _cents(c: str) -> Column:
    return F.rint(F.col(c) * 100).cast("long")


def _money(cents: Column, scale: int = 100) -> Column:
    """Exact sum of fixed-point amounts: whole units are added, then scaled once."""
    return F.sum(cents) / scale


class Views:
    """Lazy domain DataFrames for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    # prices ---------------------------------------------------------------------------------

    def price_history(self) -> DataFrame:
        coin = (
            F.when(F.col("o_orderpriority") == "1-URGENT", "terra-luna")
            .when(F.col("o_orderpriority") == "2-HIGH", "bitcoin")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "ethereum")
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "solana")
            .otherwise("cardano")
        )
        return (
            self.table("orders")
            .groupBy(coin.alias("coin_id"), day("o_orderdate").cast("timestamp_ntz").alias("timestamp"))
            .agg(
                F.lit("usd").alias("vs_currency"),
                (50 + F.max("o_totalprice") / 20000).alias("price"),
                F.count(F.lit(1)).cast("double").alias("total_volume"),
                _money(_cents("o_totalprice")).alias("market_cap"),
            )
        )

    # vaults ---------------------------------------------------------------------------------

    def token_dim(self) -> DataFrame:
        return dim(self.spark, TOKEN_ROWS, "coin_id string, token string")

    def vault_events(self) -> DataFrame:
        """Events of vaults; a few lack the vault or the amount."""
        slot = F.pmod(F.col("event_id"), 1 + F.pmod(F.col("user_id"), F.lit(5)))
        vault = F.element_at(F.array(*[F.lit(v) for v in VAULTS]), (slot + 1).cast("int"))
        return self.table("events").select(
            F.col("ts").alias("block_timestamp"),
            F.when(F.col("event_type") == "error", "withdrawal").otherwise("deposit").alias("type"),
            F.when(F.pmod("event_id", F.lit(97)) != 5, vault).alias("vault"),
            F.when(F.pmod("event_id", F.lit(4999)) != 17, F.col("value")).alias("amount"),
            F.col("user_id").cast("string").alias("address"),
        )

    def vault_quotes(self) -> DataFrame:
        """Daily quotes stamped at the midnight that ends the day; without a price on Saturdays and Sundays."""
        coins = F.array(*[F.lit(c) for c, _ in TOKEN_ROWS])
        coin = F.element_at(coins, (F.pmod(F.col("event_id"), F.lit(5)) + 1).cast("int"))
        return (
            self.table("events")
            .groupBy(coin.alias("coin_id"), F.date_add(day("ts"), 1).cast("timestamp_ntz").alias("timestamp"))
            .agg(F.max(F.when(F.weekday(F.to_date("ts")) < 5, F.col("value"))).alias("price"))
        )

    # pools ----------------------------------------------------------------------------------

    def _pools(self) -> DataFrame:
        native = F.concat(F.translate("r_name", " ", ""), F.lit("."), F.translate("n_name", "_", ""))
        name = F.concat(native, F.lit("-0X"), F.col("n_nationkey").cast("string"))
        nations = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        ).select("n_nationkey", name.alias("pool_name"), native.alias("native_name"))
        return self.table("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey").alias("l_suppkey"), "pool_name", "native_name"
        )

    def _pool_lines(self) -> DataFrame:
        return self.table("lineitem").join(self._pools(), "l_suppkey")

    def pool_daily(self) -> DataFrame:
        price = _cents("l_extendedprice")
        back = F.col("l_returnflag") == "R"
        days = self._pool_lines().groupBy(day("l_shipdate").alias("day"), "pool_name").agg(
            _money(F.when(~back, price).otherwise(0)).alias("added_liquidity_usd"),
            _money(F.when(back, price).otherwise(0)).alias("withdrawn_liquidity_usd"),
            F.sum("l_quantity").alias("asset_liquidity"),
            F.count(F.lit(1)).cast("double").alias("rune_liquidity"),
            F.max("l_extendedprice").alias("asset_price_usd"),
            (5 + F.max("l_discount") * 10).alias("rune_price_usd"),
        )
        tvl = F.col("asset_liquidity") * F.col("asset_price_usd") + F.col("rune_liquidity") * F.col("rune_price_usd")
        return days.withColumn("tvl", tvl)

    def platform_tvl(self) -> DataFrame:
        """The platform's own daily total; missing on Sundays."""
        total = F.when(F.weekday("day") != 6, F.sum("tvl") + 1000)
        return self.pool_daily().groupBy("day").agg(total.alias("total_value_pooled_usd"))

    def pool_swaps_raw(self) -> DataFrame:
        """Daily swap totals with synthetic (``/``) and native (``.``) spellings of the same asset."""
        native = F.col("native_name")
        asset = F.when(F.pmod(F.col("l_linenumber"), F.lit(2)) == 1, F.lit("RUNE")).otherwise(
            F.when(F.col("l_returnflag") == "A", F.translate(native, ".", "/")).otherwise(native)
        )
        fee = _cents("l_extendedprice") * _cents("l_tax")
        return self._pool_lines().groupBy(
            day("l_shipdate").cast("timestamp_ntz").alias("date"), asset.alias("from_asset"), "pool_name"
        ).agg(
            _money(fee, 10_000).alias("fees_usd"),
            _money(_cents("l_extendedprice")).alias("from_amount_usd"),
            F.count(F.lit(1)).alias("swaps"),
        )

    def pool_swaps(self) -> DataFrame:
        """Single swaps against a pool, with their fee."""
        native = F.col("native_name")
        return self._pool_lines().select(
            F.col("l_shipdate").alias("block_timestamp"),
            "pool_name",
            F.when(F.pmod(F.col("l_linenumber"), F.lit(2)) == 1, "RUNE").otherwise(native).alias("from_asset"),
            (F.col("l_extendedprice") * F.col("l_tax")).alias("fee_usd"),
            F.col("l_extendedprice").alias("from_amount_usd"),
        )

    # swaps, accounts and ledgers --------------------------------------------------------------

    def swaps(self) -> DataFrame:
        lines = self.table("lineitem").join(
            self.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
        )
        program = (
            F.when(F.col("l_returnflag") == "A", "tinyman")
            .when(F.col("l_returnflag") == "N", "algofi")
            .otherwise("pactfi")
        )
        asset_from, asset_to = F.pmod("l_partkey", F.lit(12)), F.pmod("l_suppkey", F.lit(15))
        # a few swaps lack the name of an asset
        named_from, named_to = F.pmod("l_orderkey", F.lit(101)) != 7, F.pmod("l_orderkey", F.lit(103)) != 9
        return lines.select(
            F.col("l_shipdate").alias("block_timestamp"),
            F.col("o_custkey").cast("string").alias("swapper"),
            program.alias("swap_program"),
            asset_from.cast("string").alias("swap_from_asset_id"),
            F.when(named_from, F.concat(F.lit("ASA"), asset_from.cast("string"))).alias("swap_from_name"),
            asset_to.cast("string").alias("swap_to_asset_id"),
            F.when(named_to, F.concat(F.lit("ASA"), asset_to.cast("string"))).alias("swap_to_name"),
            F.when(F.col("l_discount") == 0, F.lit(0.0)).otherwise(F.col("l_quantity")).alias("swap_from_amount"),
        )

    def accounts(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").cast("string").alias("address"),
            (F.col("c_acctbal") * 100).alias("balance"),
            F.when(F.col("c_mktsegment") == "MACHINERY", "lsig").otherwise("sig").alias("wallet_type"),
            (F.col("c_nationkey") == 0).alias("account_closed"),
        )

    def labels(self) -> DataFrame:
        return self.table("labels").select(F.col("doc_id").cast("string").alias("address"))

    def transfers(self) -> DataFrame:
        """Transfers between customers; a few lack the receiver."""
        customers = self.table("customer").agg(F.count(F.lit(1))).scalar()
        to = F.pmod(F.col("o_custkey") * 7 + 3, customers)
        return self.table("orders").select(
            F.col("o_orderkey").cast("string").alias("tx_id"),
            F.col("o_custkey").cast("string").alias("from_address"),
            F.when(F.pmod("o_orderkey", F.lit(211)) != 5, to.cast("string")).alias("to_address"),
            F.col("o_totalprice").alias("amount"),
        )

    def liquidity_actions(self) -> DataFrame:
        """Deposits and withdrawals of customers; those of a few orders lack the wallet."""
        owner = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        return self._pool_lines().join(owner, "l_orderkey").select(
            F.when(F.pmod("l_orderkey", F.lit(1009)) != 11, F.col("o_custkey").cast("string")).alias("address"),
            "pool_name",
            F.when(F.col("l_returnflag") == "R", "withdraw").otherwise("deposit").alias("action"),
            F.col("l_quantity").alias("stake_units"),
        )
