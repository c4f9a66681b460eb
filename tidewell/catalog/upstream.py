from pyspark.sql import functions as F

from tidewell.catalog.base import query
from tidewell.catalog.sql import views
from tidewell.functions.names import TOKEN_ROWS
from tidewell.plans import upstream as u
from tidewell.sources.io import dim

SINCE = "1996-01-01"


@query(
    "u1_wallet_swap_stats",
    "swapper swaps:int swapped_for:int",
    f"""{views("swaps")}
--
SELECT swapper, count(*) AS swaps, count(DISTINCT swap_to_asset_id) AS swapped_for FROM swaps
WHERE swap_from_amount > 0 AND block_timestamp >= TIMESTAMP '{SINCE}' GROUP BY 1""",
)
def wallet_swap_stats(v):
    return u.wallet_swap_stats(v.swaps(), SINCE)


@query(
    "u2_asset_popularity",
    "swap_to_asset_id asset_name swaps:int rank:int",
    f"""{views("asset_popularity")}
--
SELECT * FROM asset_popularity""",
)
def asset_popularity(v):
    return u.asset_popularity(v.swaps())


@query(
    "u2_asset_popularity_by_dex",
    "swap_program swap_to_asset_id asset_name swaps:int rank:int",
    f"""{views("asset_popularity_by_dex")}
--
SELECT * FROM asset_popularity_by_dex""",
)
def asset_popularity_by_dex(v):
    return u.asset_popularity(v.swaps(), by_dex=True)


@query(
    "u3_identify_whales",
    "address balance:4",
    f"""{views("whales")}
--
SELECT * FROM whales""",
)
def identify_whales(v):
    return u.identify_whales(v.accounts(), v.labels())


PROGRAM = "vault-program"
VAULT_ROWS = [(f"account-{t}", f"mint-{t}", t) for _, t in TOKEN_ROWS]


def raw_transactions(v):
    """Nested transaction events out of the event table.

    Views are deposits, clicks transfers of a foreign token, errors withdrawals, sign-ups burns
    without a transfer, and purchases calls of another program.
    """
    kind, vault = F.col("type"), F.col("vault")
    filler = [F.lit(f"account {i}") for i in range(2, 7)]
    mint = F.when(kind == "click", F.lit("mint-other")).otherwise(F.concat(F.lit("mint-"), vault))

    def step(name, amount):
        return F.struct(F.lit(name).alias("type"), amount.alias("amount"))

    amount, nothing = F.col("value"), F.lit(None).cast("double")
    inner = (
        F.when(kind.isin("view", "click", "purchase"), F.array(step("transfer", amount)))
        .when(kind == "error", F.array(step("burn", nothing), step("transfer", amount)))
        .otherwise(F.array(step("burn", nothing)))
    )
    events = v.table("events").withColumn("type", F.col("event_type"))
    tokens = F.array(*[F.lit(t) for _, _, t in VAULT_ROWS])
    named = events.withColumn("vault", F.element_at(tokens, (F.pmod(F.col("event_id"), F.lit(5)) + 1).cast("int")))
    return named.select(
        F.col("ts").alias("block_timestamp"),
        F.when(kind == "purchase", "other-program").otherwise(PROGRAM).alias("program_id"),
        F.array(F.concat(F.lit("account-"), vault), *filler, mint).alias("accounts"),
        inner.alias("inner_instructions"),
        F.col("user_id").cast("string").alias("signer"),
    )


@query(
    "u4_extract_vault_events",
    "block_timestamp:time type vault amount:4 address",
    """
--
SELECT ts AS block_timestamp, CASE event_type WHEN 'view' THEN 'deposit' ELSE 'withdrawal' END AS type,
       CASE event_id % 5 WHEN 0 THEN 'SOL' WHEN 1 THEN 'mSOL' WHEN 2 THEN 'BTC' WHEN 3 THEN 'ETH' ELSE 'LUNA' END AS vault,
       value AS amount, CAST(user_id AS VARCHAR) AS address FROM events WHERE event_type IN ('view', 'error')""",
)
def extract_vault_events(v):
    vaults = dim(v.spark, VAULT_ROWS, "address string, token string, vault string")
    return u.extract_vault_events(raw_transactions(v), vaults, PROGRAM)


@query(
    "u5_ledger_balances",
    "address rune_wallet_balance:2 rune_lp_balance:2 rune_total_balance:2",
    f"""{views("balances")}
--
SELECT * FROM balances""",
)
def ledger_balances(v):
    return u.ledger_balances(v.transfers(), v.liquidity_actions())


@query(
    "u6_net_lp_positions",
    "wallet pool_name lp_position:2",
    f"""{views("lp_positions")}
--
SELECT * FROM lp_positions""",
)
def net_lp_positions(v):
    return u.net_lp_positions(v.liquidity_actions())


@query(
    "u7_daily_pool_stats",
    "date:day pool_name from_asset fees_usd:4 from_amount_usd:4 swaps:int",
    f"""{views("pools")}
--
SELECT CAST(l_shipdate AS DATE) AS date, pool_name, CASE WHEN l_linenumber % 2 = 1 THEN 'RUNE' ELSE split_part(pool_name, '-', 1) END
       AS from_asset, sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2))) AS fees_usd,
       sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS from_amount_usd, count(*) AS swaps
FROM lineitem JOIN pools ON l_suppkey = s_suppkey GROUP BY 1, 2, 3""",
)
def daily_pool_stats(v):
    return u.daily_pool_stats(v.pool_swaps())
