from tidewell.catalog.base import query
from tidewell.catalog.charts import ecdf_sql, histogram_sql
from tidewell.catalog.sql import views
from tidewell.operators import distribution as d
from tidewell.plans import popularity as pop
from tidewell.plans import upstream as u
from tidewell.plans import wallets as w

PROBS = (0.3, 0.8, 0.9, 0.99, 0.999)


def _stats(v):
    return u.wallet_swap_stats(v.swaps())


def _balances(v):
    return u.ledger_balances(v.transfers(), v.liquidity_actions())


@query(
    "q31_log_histogram_swaps_per_wallet",
    "bin:int x_min:8 x_max:8 frequency:9",
    histogram_sql(views("wallet_swap_stats"), "wallet_swap_stats", "swaps", 18),
)
def histogram_swaps(v):
    return w.log_histogram(_stats(v), "swaps", 18)


@query(
    "q31_log_histogram_assets_per_wallet",
    "bin:int x_min:8 x_max:8 frequency:9",
    histogram_sql(views("wallet_swap_stats"), "wallet_swap_stats", "swapped_for", 13),
)
def histogram_assets(v):
    return w.log_histogram(_stats(v), "swapped_for", 13)


@query(
    "q31_log_histogram_balances",
    "bin:int x_min:8 x_max:8 count:int",
    histogram_sql(views("balances"), "balances", "rune_total_balance", 18),
)
def histogram_balances(v):
    return w.log_histogram(_balances(v), "rune_total_balance", 18, freq=False)


@query(
    "q32_inverse_cdf_swaps",
    "cume_dist:9 swaps:int",
    f"""{views("wallet_swap_stats")}
--
SELECT cume_dist() OVER (ORDER BY swaps) AS cume_dist, swaps FROM wallet_swap_stats""",
)
def inverse_cdf_swaps(v):
    return w.inverse_cdf(_stats(v), "swaps")


@query(
    "q32_inverse_cdf_balances",
    "cume_dist:9 rune_total_balance:2",
    f"""{views("balances")}
--
SELECT cume_dist() OVER (ORDER BY round(rune_total_balance, 2)) AS cume_dist, rune_total_balance FROM balances""",
)
def inverse_cdf_balances(v):
    from pyspark.sql import functions as F

    cents = _balances(v).withColumn("rune_total_balance", F.round("rune_total_balance", 2))
    return w.inverse_cdf(cents, "rune_total_balance")


@query(
    "q33_quantile_table",
    "prob:4 quantile:int",
    f"""{views("wallet_swap_stats")},
c AS (SELECT swaps, cume_dist() OVER (ORDER BY swaps) AS cd FROM wallet_swap_stats)
--
SELECT prob, min(swaps) AS quantile FROM c, (VALUES {", ".join(f"({p})" for p in PROBS)}) AS t(prob)
WHERE cd >= CAST(prob AS DOUBLE) GROUP BY 1""",
)
def quantile_table(v):
    return w.quantile_table(_stats(v), "swaps", PROBS)


@query(
    "q34_clamp_and_rank_holdings",
    "address rune_wallet_balance:2 rune_lp_balance:2 rune_total_balance:2",
    f"""{views("balances")}
--
SELECT * REPLACE (greatest(rune_total_balance, 0) AS rune_total_balance) FROM balances""",
)
def clamp_and_rank_holdings(v):
    return w.clamp_and_rank_holdings(_balances(v))


@query(
    "a11_ecdf_by_group",
    "swap_program amount:4 ecdf:9",
    ecdf_sql(
        f"{views('swaps')}, t AS (SELECT swap_program, swap_from_amount AS amount FROM swaps)", "t", "amount", "swap_program"
    ),
)
def ecdf_by_group(v):
    return d.ecdf(v.swaps().withColumnRenamed("swap_from_amount", "amount"), "amount", ["swap_program"])


@query(
    "a19_exact_quantiles_by_group",
    "l_returnflag prob:4 quantile:6",
    """
--
SELECT l_returnflag, 0.01 AS prob, quantile_cont(l_extendedprice, 0.01) AS quantile FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 0.25, quantile_cont(l_extendedprice, 0.25) FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 0.5, quantile_cont(l_extendedprice, 0.5) FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 0.75, quantile_cont(l_extendedprice, 0.75) FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 0.99, quantile_cont(l_extendedprice, 0.99) FROM lineitem GROUP BY 1""",
)
def exact_quantiles(v):
    return d.quantiles(v.table("lineitem"), "l_extendedprice", [0.01, 0.25, 0.5, 0.75, 0.99], ["l_returnflag"])


@query(
    "q35_top_assets",
    "swap_to_asset_id asset_name swaps:int rank:int sort_key:int",
    f"""{views("asset_popularity")}
--
SELECT *, -swaps AS sort_key FROM asset_popularity WHERE rank <= 10""",
)
def top_assets(v):
    return pop.top_assets(u.asset_popularity(v.swaps(), n=10))


@query(
    "q36_top_assets_by_dex",
    "swap_program swap_to_asset_id asset_name swaps:int rank:int sort_key:int",
    f"""{views("asset_popularity_by_dex")}
--
SELECT *, -swaps AS sort_key FROM asset_popularity_by_dex WHERE rank <= 10""",
)
def top_assets_by_dex(v):
    return pop.top_assets_by_dex(u.asset_popularity(v.swaps(), by_dex=True, n=10))


@query(
    "q36_top_assets_by_dex_wide",
    "rank:int algofi pactfi tinyman",
    f"""{views("asset_popularity_by_dex")}
--
SELECT rank, max(asset_name) FILTER (swap_program = 'algofi') AS algofi,
       max(asset_name) FILTER (swap_program = 'pactfi') AS pactfi,
       max(asset_name) FILTER (swap_program = 'tinyman') AS tinyman
FROM asset_popularity_by_dex WHERE rank <= 10 GROUP BY rank""",
)
def top_assets_by_dex_wide(v):
    ranked = u.asset_popularity(v.swaps(), by_dex=True, n=10)
    return pop.top_assets_by_dex(ranked, wide=True, dexes=["algofi", "pactfi", "tinyman"])
