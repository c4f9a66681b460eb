from tidewell.catalog.base import query
from tidewell.catalog.charts import density_sql, ecdf_sql, histogram_sql
from tidewell.catalog.sql import views
from tidewell.plans import lp as l
from tidewell.plans import upstream as u
from tidewell.sources.views import Views


def _liquidity(v: Views):
    return v.pool_daily().withColumnRenamed("tvl", "total_liquidity_usd")


def _lp(v: Views):
    return l.value_lp_positions(u.net_lp_positions(v.liquidity_actions()), _liquidity(v))


def _prepared(v: Views):
    """What the distribution behind a chart needs of the valued positions."""
    return _lp(v).select("pool_name_short", "chain", "lp_position_usd")


_LP = views("lp")
_SIZES = f"""{_LP}, sizes AS (SELECT * FROM (SELECT pool_name_short, sum(lp_position_usd) AS lp_position_usd FROM lp GROUP BY 1)
  WHERE lp_position_usd > 0),
ranked AS (SELECT *, row_number() OVER (ORDER BY lp_position_usd DESC, pool_name_short) AS rn FROM sizes)"""


@query(
    "q46_value_lp_positions",
    "wallet pool_name lp_position:2 total_lp_position:2 total_liquidity_usd:2 lp_position_usd:2 pool_name_short chain",
    f"""{_LP}
--
SELECT *, sum(lp_position) OVER (PARTITION BY pool_name) AS total_lp_position FROM lp JOIN
(SELECT pool_name AS pn, total_liquidity_usd FROM pool_sizes) ON pool_name = pn""",
)
def value_lp_positions(v):
    return _lp(v)


@query(
    "q47_top_pools",
    "pool_name_short lp_position_usd:2",
    f"""{_SIZES}
--
SELECT * FROM ranked WHERE rn <= 10""",
)
def top_pools(v):
    return l.split_top_pools(_lp(v))[0]


@query(
    "q47_other_pools",
    "pool_name_short lp_position_usd:2",
    f"""{_SIZES}
--
SELECT * FROM ranked WHERE rn > 10""",
)
def other_pools(v):
    return l.split_top_pools(_lp(v))[1]


@query(
    "q48_default_pools",
    "pool_name_short lp_position_usd:2",
    f"""{_SIZES}
--
SELECT * FROM ranked WHERE rn <= 2""",
)
def default_pools(v):
    return l.default_pools(_lp(v), 2)


_CHAINS = f"""{views("pool_sizes")},
ch AS (SELECT chain, sum(total_liquidity_usd) AS total_liquidity_usd FROM pool_sizes GROUP BY 1)"""


@query(
    "q48_default_chains",
    "chain total_liquidity_usd:2",
    f"""{_CHAINS}
--
SELECT chain, total_liquidity_usd FROM ch QUALIFY rank() OVER (ORDER BY total_liquidity_usd DESC) <= 2""",
)
def default_chains(v):
    return l.default_chains(_liquidity(v))


@query(
    "q49_league_table_pool",
    "pool_name_short chain liquidity_providers:int tvl:2 rank:int",
    f"""{_LP}
--
SELECT pool_name_short, chain, count(*) AS liquidity_providers, sum(lp_position_usd) AS tvl,
       row_number() OVER (ORDER BY sum(lp_position_usd) DESC) AS rank FROM lp GROUP BY 1, 2""",
)
def league_table_pool(v):
    return l.league_table(_lp(v))


@query(
    "q49_league_table_chain",
    "chain liquidity_providers:int tvl:2 rank:int",
    f"""{_LP}
--
SELECT chain, count(*) AS liquidity_providers, sum(lp_position_usd) AS tvl,
       row_number() OVER (ORDER BY sum(lp_position_usd) DESC) AS rank FROM lp GROUP BY 1""",
)
def league_table_chain(v):
    return l.league_table(_lp(v), "chain")


_BARS = "bin:int x_min:8 x_max:8 count:int frequency:9"


def _register(by: str | None, key: str) -> None:
    name = by or "pooled"
    group = [key] if by else []
    shown = " ".join(group)

    query(
        f"q50_lp_histogram_{name}", f"{shown} {_BARS}", histogram_sql(_LP, "lp", "lp_position_usd", 20, by=" ".join(group))
    )(lambda v: l.lp_distribution(_prepared(v), None, "histogram", by))
    query(
        f"q50_lp_density_{name}",
        f"{shown} point:int x:8 density:8",
        density_sql(_LP, "lp", "lp_position_usd", key if by else "'all'").replace(
            "SELECT * FROM dn", f"SELECT *, g AS {key} FROM dn"
        ),
    )(lambda v: l.lp_distribution(_prepared(v), None, "density", by))
    query(
        f"q50_lp_ecdf_{name}", f"{shown} lp_position_usd:2 ecdf:9", ecdf_sql(_LP, "lp", "lp_position_usd", " ".join(group))
    )(lambda v: l.lp_distribution(_prepared(v), None, "ecdf", by))


_register(None, "pool_name_short")
_register("pool", "pool_name_short")
_register("chain", "chain")


@query(
    "q50_lp_histogram_default_pools",
    f"pool_name_short {_BARS}",
    histogram_sql(
        f"{_SIZES}, chosen AS (SELECT * FROM lp WHERE pool_name_short IN (SELECT pool_name_short FROM ranked WHERE rn <= 2))",
        "chosen", "lp_position_usd", 20, by="pool_name_short",
    ),
)
def histogram_default_pools(v):
    lp = _prepared(v)
    return l.lp_distribution(lp, l.default_pools(lp, 2), "histogram", "pool")


for _by, _cte, _source, _bins in (("pool", views("pool_sizes"), "pool_sizes", 10), ("chain", _CHAINS, "ch", 5)):
    query(
        f"q51_tvl_histogram_{_by}", _BARS, histogram_sql(_cte, _source, "total_liquidity_usd", _bins)
    )(lambda v, by=_by: l.tvl_distribution(_liquidity(v), "histogram", by))
    query(
        f"q51_tvl_ecdf_{_by}", "total_liquidity_usd:2 ecdf:9", ecdf_sql(_cte, _source, "total_liquidity_usd")
    )(lambda v, by=_by: l.tvl_distribution(_liquidity(v), "ecdf", by))
