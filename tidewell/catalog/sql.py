"""The domain views once more, as SQL for the oracle, and snippets the oracles share."""

from __future__ import annotations


def friday(x: str) -> str:
    return f"(CAST(date_trunc('week', CAST({x} AS DATE) - 4) AS DATE) + 4)"


def sunday_up(x: str) -> str:
    floor = f"(CAST(date_trunc('week', CAST({x} AS DATE) - 6) AS DATE) + 6)"
    return f"(CASE WHEN {x} = CAST({floor} AS TIMESTAMP) THEN {floor} ELSE {floor} + 7 END)"


def strict_sum(x: str) -> str:
    return f"CASE WHEN count({x}) = count(*) THEN sum({x}) END"


def n_distinct(x: str) -> str:
    return f"(count(DISTINCT {x}) + max(CASE WHEN {x} IS NULL THEN 1 ELSE 0 END))"


_TOKEN_CASES = "WHEN 0 THEN 'solana' WHEN 1 THEN 'msol' WHEN 2 THEN 'bitcoin' WHEN 3 THEN 'ethereum' ELSE 'terra-luna'"

# name -> (views it needs, body)
_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "price_history": (
        (),
        """SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'terra-luna' WHEN '2-HIGH' THEN 'bitcoin'
               WHEN '3-MEDIUM' THEN 'ethereum' WHEN '4-NOT SPECIFIED' THEN 'solana' ELSE 'cardano' END AS coin_id,
           CAST(o_orderdate AS DATE) AS timestamp, 'usd' AS vs_currency,
           50 + max(o_totalprice) / 20000 AS price, CAST(count(*) AS DOUBLE) AS total_volume,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS market_cap
           FROM orders GROUP BY 1, 2""",
    ),
    "named_prices": (
        ("price_history",),
        "SELECT * REPLACE (replace(coin_id, 'terra-luna', 'luna') AS coin_id) FROM price_history",
    ),
    "token_dim": (
        (),
        """SELECT * FROM (VALUES ('solana', 'SOL'), ('msol', 'mSOL'), ('bitcoin', 'BTC'), ('ethereum', 'ETH'),
           ('terra-luna', 'LUNA')) AS t(coin_id, token)""",
    ),
    "vault_events": (
        (),
        """SELECT ts AS block_timestamp, CASE WHEN event_type = 'error' THEN 'withdrawal' ELSE 'deposit' END AS type,
           CASE WHEN event_id % 97 <> 5 THEN CASE event_id % (1 + user_id % 5) WHEN 0 THEN 'SOL' WHEN 1 THEN 'mSOL' WHEN 2 THEN 'BTC'
                WHEN 3 THEN 'ETH' ELSE 'LUNA' END END AS vault,
           CASE WHEN event_id % 4999 <> 17 THEN value END AS amount, CAST(user_id AS VARCHAR) AS address FROM events""",
    ),
    "vault_quotes": (
        (),
        f"""SELECT CASE event_id % 5 {_TOKEN_CASES} END AS coin_id,
           CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) AS timestamp, max(value) FILTER (WHERE isodow(ts) < 6) AS price
           FROM events GROUP BY 1, 2""",
    ),
    "vault_rates": (
        ("vault_quotes", "token_dim"),
        """SELECT q.coin_id, CAST(timestamp - INTERVAL 1 SECOND AS DATE) AS date, price, token
           FROM vault_quotes q LEFT JOIN token_dim USING (coin_id)""",
    ),
    "pools": (
        (),
        """SELECT s_suppkey, replace(r_name, ' ', '') || '.' || replace(n_name, '_', '') || '-0X' || n_nationkey AS pool_name
           FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    "pool_daily": (
        ("pools",),
        """SELECT *, asset_liquidity * asset_price_usd + rune_liquidity * rune_price_usd AS tvl FROM (
           SELECT CAST(l_shipdate AS DATE) AS day, pool_name,
           CAST(sum(CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS added_liquidity_usd,
           CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS withdrawn_liquidity_usd,
           sum(l_quantity) AS asset_liquidity, CAST(count(*) AS DOUBLE) AS rune_liquidity,
           max(l_extendedprice) AS asset_price_usd, 5 + max(l_discount) * 10 AS rune_price_usd
           FROM lineitem JOIN pools ON l_suppkey = s_suppkey GROUP BY 1, 2)""",
    ),
    "platform_tvl": (
        ("pool_daily",),
        "SELECT day, CASE WHEN isodow(day) <> 7 THEN sum(tvl) + 1000 END AS total_value_pooled_usd FROM pool_daily GROUP BY day",
    ),
    "pool_swaps_raw": (
        ("pools",),
        """SELECT CAST(l_shipdate AS DATE) AS date,
           CASE WHEN l_linenumber % 2 = 1 THEN 'RUNE' WHEN l_returnflag = 'A' THEN replace(split_part(pool_name, '-', 1), '.', '/')
                ELSE split_part(pool_name, '-', 1) END AS from_asset, pool_name,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2))) AS DOUBLE) AS fees_usd,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS from_amount_usd, count(*) AS swaps
           FROM lineitem JOIN pools ON l_suppkey = s_suppkey GROUP BY 1, 2, 3""",
    ),
    "pool_swaps_daily": (
        ("pool_swaps_raw",),
        """SELECT date, replace(from_asset, '/', '.') AS from_asset, pool_name, sum(fees_usd) AS fees_usd,
           sum(from_amount_usd) AS from_amount_usd, sum(swaps) AS swaps FROM pool_swaps_raw GROUP BY 1, 2, 3""",
    ),
    "swaps": (
        (),
        """SELECT l_shipdate AS block_timestamp, CAST(o_custkey AS VARCHAR) AS swapper,
           CASE l_returnflag WHEN 'A' THEN 'tinyman' WHEN 'N' THEN 'algofi' ELSE 'pactfi' END AS swap_program,
           CAST(l_partkey % 12 AS VARCHAR) AS swap_from_asset_id, CASE WHEN l_orderkey % 101 <> 7 THEN 'ASA' || (l_partkey % 12) END AS swap_from_name,
           CAST(l_suppkey % 15 AS VARCHAR) AS swap_to_asset_id, CASE WHEN l_orderkey % 103 <> 9 THEN 'ASA' || (l_suppkey % 15) END AS swap_to_name,
           CASE WHEN l_discount = 0 THEN 0 ELSE l_quantity END AS swap_from_amount
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    ),
    "wallet_swap_stats": (
        ("swaps",),
        """SELECT swapper, count(*) AS swaps, count(DISTINCT swap_to_asset_id) AS swapped_for FROM swaps
           WHERE swap_from_amount > 0 GROUP BY 1""",
    ),
    "asset_popularity": (
        ("swaps",),
        """SELECT swap_to_asset_id, swap_to_name AS asset_name, count(*) AS swaps,
           row_number() OVER (ORDER BY count(*) DESC, swap_to_asset_id) AS rank
           FROM swaps WHERE swap_from_amount > 0 GROUP BY 1, 2""",
    ),
    "asset_popularity_by_dex": (
        ("swaps",),
        """SELECT swap_program, swap_to_asset_id, swap_to_name AS asset_name, count(*) AS swaps,
           row_number() OVER (PARTITION BY swap_program ORDER BY count(*) DESC, swap_to_asset_id) AS rank
           FROM swaps WHERE swap_from_amount > 0 GROUP BY 1, 2, 3""",
    ),
    "whales": (
        (),
        """SELECT CAST(c_custkey AS VARCHAR) AS address, c_acctbal * 100 AS balance FROM customer
           WHERE c_nationkey <> 0 AND c_mktsegment <> 'MACHINERY' AND c_acctbal * 100 >= 200000
           AND c_custkey NOT IN (SELECT doc_id FROM labels)""",
    ),
    "whale_swaps": (
        ("swaps", "whales"),
        "SELECT * FROM swaps WHERE swapper IN (SELECT address FROM whales)",
    ),
    "liquidity_actions": (
        ("pools",),
        """SELECT CASE WHEN l_orderkey % 1009 <> 11 THEN CAST(o_custkey AS VARCHAR) END AS address, pool_name,
           CASE WHEN l_returnflag = 'R' THEN 'withdraw' ELSE 'deposit' END AS action, l_quantity AS stake_units
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN pools ON l_suppkey = s_suppkey""",
    ),
    "lp_positions": (
        ("liquidity_actions",),
        """SELECT address AS wallet, pool_name,
           sum(CASE WHEN action = 'withdraw' THEN -stake_units ELSE stake_units END) AS lp_position
           FROM liquidity_actions GROUP BY 1, 2""",
    ),
    "balances": (
        ("liquidity_actions",),
        """SELECT coalesce(a.address, b.address) AS address, coalesce(w, 0) AS rune_wallet_balance, coalesce(l, 0) AS rune_lp_balance,
           coalesce(w, 0) + coalesce(l, 0) AS rune_total_balance FROM
           (SELECT address, sum(amount) AS w FROM (
              SELECT CAST(o_custkey AS VARCHAR) AS address, -o_totalprice AS amount FROM orders
              UNION ALL SELECT CASE WHEN o_orderkey % 211 <> 5 THEN CAST((o_custkey * 7 + 3) % (SELECT count(*) FROM customer) AS VARCHAR) END, o_totalprice FROM orders) GROUP BY 1) a
           FULL JOIN
           (SELECT address, sum(CASE WHEN action = 'withdraw' THEN -stake_units ELSE stake_units END) AS l
            FROM liquidity_actions GROUP BY 1) b ON a.address IS NOT DISTINCT FROM b.address""",
    ),
    "pool_sizes": (
        ("pool_daily",),
        """SELECT pool_name, arg_max(tvl, day) AS total_liquidity_usd, split_part(pool_name, '-', 1) AS pool_name_short,
           split_part(pool_name, '.', 1) AS chain FROM pool_daily GROUP BY pool_name""",
    ),
    "lp": (
        ("lp_positions", "pool_sizes"),
        """SELECT wallet, pool_name, pool_name_short, chain, lp_position,
           lp_position / sum(lp_position) OVER (PARTITION BY pool_name) * total_liquidity_usd AS lp_position_usd
           FROM lp_positions LEFT JOIN pool_sizes USING (pool_name) WHERE lp_position > 0""",
    ),
}


def views(*names: str) -> str:
    """``WITH`` clause defining the named views and all they rest on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in _VIEWS[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({_VIEWS[n][1]})" for n in ordered)
