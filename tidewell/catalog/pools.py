from tidewell.catalog.base import query
from tidewell.catalog.sql import views
from tidewell.plans import pools as p
from tidewell.plans import tvl as t

_SUMS = "sum(fees_usd) AS fees_usd, sum(from_amount_usd) AS from_amount_usd, sum(swaps) AS swaps"


def _canonical(v):
    return p.canonical_pool_swaps(v.pool_swaps_raw())


@query(
    "q37_canonical_pool_swaps",
    "date:day from_asset pool_name fees_usd:4 from_amount_usd:4 swaps:int",
    f"""{views("pool_swaps_daily")}
--
SELECT * FROM pool_swaps_daily""",
)
def canonical_pool_swaps(v):
    return _canonical(v)


@query(
    "q38_since_inception",
    "date:day date_reference:day day:int pool_name fees_usd:4 from_amount_usd:4 swaps:int",
    f"""{views("pool_swaps_daily")},
i AS (SELECT *, min(date) OVER (PARTITION BY pool_name) AS date_reference FROM pool_swaps_daily)
--
SELECT date, date_reference, date - date_reference AS day, pool_name, {_SUMS} FROM i
WHERE date - date_reference <= 3 GROUP BY 1, 2, 3, 4""",
)
def since_inception(v):
    return p.since_inception(_canonical(v))


@query(
    "q39_pool_summary",
    "date:day pool_name fees_usd:4 from_amount_usd:4 swaps:int",
    f"""{views("pool_swaps_daily")}
--
SELECT date, pool_name, {_SUMS} FROM pool_swaps_daily GROUP BY 1, 2""",
)
def pool_summary(v):
    return p.pool_summary(_canonical(v))


@query(
    "q40_origination_share_volume",
    "date:day pool_name from_asset from_amount_usd:4 share:9",
    f"""{views("pool_swaps_daily")}
--
SELECT *, from_amount_usd / sum(from_amount_usd) OVER (PARTITION BY date, pool_name) AS share FROM pool_swaps_daily""",
)
def origination_share_volume(v):
    return p.origination_share(_canonical(v))


@query(
    "q40_origination_share_count",
    "date:day pool_name from_asset swaps:int share:9",
    f"""{views("pool_swaps_daily")}
--
SELECT *, swaps / sum(swaps) OVER (PARTITION BY date, pool_name) AS share FROM pool_swaps_daily""",
)
def origination_share_count(v):
    return p.origination_share(_canonical(v), measure="swaps")


_TVL = f"""{views("pool_daily", "platform_tvl")},
m0 AS (SELECT *, sum(added_liquidity_usd - withdrawn_liquidity_usd) OVER (PARTITION BY pool_name ORDER BY day
         ROWS UNBOUNDED PRECEDING) AS locked,
       asset_liquidity * last_value(asset_price_usd) OVER w + rune_liquidity * last_value(rune_price_usd) OVER w AS normalized
       FROM pool_daily WINDOW w AS (PARTITION BY pool_name ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
grid AS (SELECT * FROM (SELECT DISTINCT day FROM pool_daily), (SELECT DISTINCT pool_name FROM pool_daily)),
j AS (SELECT grid.day, grid.pool_name, locked, tvl - locked AS gained, tvl, normalized FROM grid LEFT JOIN m0
      ON grid.day = m0.day AND grid.pool_name = m0.pool_name),
metrics AS (SELECT * FROM (SELECT day, pool_name, last_value(locked IGNORE NULLS) OVER f AS dollar_value_locked,
       last_value(gained IGNORE NULLS) OVER f AS dollar_value_gained, last_value(tvl IGNORE NULLS) OVER f AS tvl,
       last_value(normalized IGNORE NULLS) OVER f AS normalized_tvl,
       regexp_extract(pool_name, '^[[:alnum:]]+') AS blockchain,
       regexp_extract(pool_name, '\\.([[:alnum:]]+)(?:$|-)', 1) AS token
       FROM j WINDOW f AS (PARTITION BY pool_name ORDER BY day ROWS UNBOUNDED PRECEDING))
     WHERE dollar_value_locked IS NOT NULL)"""


def _long(*variables: str) -> str:
    return " UNION ALL ".join(
        f"SELECT day, '{x}' AS variable, sum({x}) AS value FROM metrics GROUP BY day" for x in variables
    )


def _metrics(v):
    return t.tvl_metrics(v.pool_daily())


@query(
    "q41_tvl_metrics",
    "day:day pool_name dollar_value_locked:4 dollar_value_gained:4 tvl:4 normalized_tvl:4 blockchain token",
    f"""{_TVL}
--
SELECT * FROM metrics""",
)
def tvl_metrics(v):
    return _metrics(v)


@query(
    "q42_protocol_tvl",
    "day:day variable value:4",
    f"""{_TVL}
--
{_long("dollar_value_locked", "tvl", "normalized_tvl")}""",
)
def protocol_tvl(v):
    return t.protocol_tvl(_metrics(v))


@query(
    "q42_protocol_tvl_gained",
    "day:day variable value:4",
    f"""{_TVL}
--
{_long("dollar_value_locked", "dollar_value_gained", "tvl")}""",
)
def protocol_tvl_gained(v):
    return t.protocol_tvl(_metrics(v), ("dollar_value_locked", "dollar_value_gained", "tvl"))


_TOTALS = "sum(dollar_value_locked) AS dollar_value_locked, sum(normalized_tvl) AS normalized_tvl, sum(tvl) AS tvl"


@query(
    "q43_tvl_by_chain",
    "day:day blockchain dollar_value_locked:4 normalized_tvl:4 tvl:4",
    f"""{_TVL}
--
SELECT day, blockchain, {_TOTALS} FROM metrics GROUP BY 1, 2""",
)
def tvl_by_chain(v):
    return t.tvl_by_chain(_metrics(v))


@query(
    "q44_tvl_by_chain_token",
    "day:day blockchain token dollar_value_locked:4 normalized_tvl:4 tvl:4",
    f"""{_TVL}
--
SELECT day, blockchain, token, {_TOTALS} FROM metrics GROUP BY 1, 2, 3""",
)
def tvl_by_chain_token(v):
    return t.tvl_by_chain_token(_metrics(v))


@query(
    "q45_reconcile_tvl",
    "day:day variable value:4",
    f"""{_TVL}, own AS (SELECT day, sum(tvl) AS tvl FROM metrics GROUP BY 1)
--
SELECT day, 'tvl' AS variable, tvl AS value FROM own
UNION ALL SELECT own.day, 'total_value_pooled_usd', total_value_pooled_usd FROM own LEFT JOIN platform_tvl p ON own.day = p.day""",
)
def reconcile_tvl(v):
    return t.reconcile_tvl(_metrics(v), v.platform_tvl())
