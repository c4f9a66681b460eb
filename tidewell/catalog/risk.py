from tidewell.catalog.base import query
from tidewell.catalog.sql import views
from tidewell.plans import risk as r

_INDEX = f"""{views("named_prices")},
totals AS (SELECT timestamp, sum(market_cap) AS market_cap FROM named_prices GROUP BY 1),
idx AS (SELECT 'index' AS coin_id, timestamp, market_cap / first_value(market_cap) OVER (ORDER BY timestamp) * 100 AS price,
        market_cap FROM totals),
series AS (SELECT coin_id, timestamp, price FROM named_prices UNION ALL SELECT coin_id, timestamp, price FROM idx)"""

_NORM = f"""{_INDEX},
n0 AS (SELECT coin_id, timestamp, price / first_value(price) OVER (PARTITION BY coin_id ORDER BY timestamp) * 100 AS price
       FROM series),
n1 AS (SELECT *, max(price) OVER (PARTITION BY coin_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS cum_max FROM n0),
norm AS (SELECT *, price / cum_max - 1 AS drawdown FROM n1)"""

_RETURNS = f"""{_INDEX},
ra AS (SELECT coin_id, timestamp, coalesce(price / lag(price) OVER (PARTITION BY coin_id ORDER BY timestamp) - 1, 0) AS ra
       FROM series),
ret AS (SELECT a.coin_id, a.timestamp, a.ra, b.ra AS rb FROM ra a LEFT JOIN
        (SELECT timestamp, ra FROM ra WHERE coin_id = 'index') b ON a.timestamp = b.timestamp)"""


def _prices(v):
    return r.clean_prices(v.price_history())


@query(
    "q10_market_cap_index",
    "coin_id timestamp:day price:6 market_cap:2",
    f"""{_INDEX}
--
SELECT * FROM idx""",
)
def market_cap_index(v):
    return r.market_cap_index(_prices(v))


@query(
    "q11_normalize_and_drawdown",
    "coin_id timestamp:day price:6 cum_max:6 drawdown:8",
    f"""{_NORM}
--
SELECT * FROM norm""",
)
def normalize_and_drawdown(v):
    return r.normalize_and_drawdown(v.price_history())


@query(
    "q12_rolling_drawdown",
    "coin_id timestamp:day rolling_max:6 rolling_drawdown:8",
    f"""{_NORM}, m AS (SELECT *, max(price) OVER (PARTITION BY coin_id ORDER BY timestamp
      ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS rolling_max FROM norm)
--
SELECT *, price / rolling_max - 1 AS rolling_drawdown FROM m""",
)
def rolling_drawdown(v):
    return r.rolling_drawdown(r.normalize_and_drawdown(v.price_history()))


@query(
    "q13_monthly_max_drawdown",
    "coin_id timestamp:day month_date:day month_cum_max:6 month_drawdown:8 month_max_drawdown:8",
    f"""{_NORM}, m AS (SELECT *, CAST(date_trunc('month', timestamp) AS DATE) AS month_date FROM norm),
c AS (SELECT *, max(price) OVER (PARTITION BY coin_id, month_date ORDER BY timestamp ROWS UNBOUNDED PRECEDING)
      AS month_cum_max FROM m),
d AS (SELECT *, price / month_cum_max - 1 AS month_drawdown FROM c)
--
SELECT *, min(month_drawdown) OVER (PARTITION BY coin_id, month_date) AS month_max_drawdown FROM d""",
)
def monthly_max_drawdown(v):
    return r.monthly_max_drawdown(r.normalize_and_drawdown(v.price_history()))


@query(
    "q14_returns_vs_benchmark",
    "coin_id timestamp:day ra:8 rb:8",
    f"""{_RETURNS}
--
SELECT * FROM ret""",
)
def returns_vs_benchmark(v):
    return r.returns_vs_benchmark(_prices(v))


def _returns(v):
    return r.returns_vs_benchmark(_prices(v))


@query(
    "q15_downside_risk_table",
    "coin_id downside_deviation:8 historical_var:8 modified_var:8 maximum_drawdown:8",
    f"""{_RETURNS},
mean AS (SELECT coin_id, avg(ra) AS mu FROM ret GROUP BY 1),
mom AS (SELECT coin_id, any_value(mu) AS mu, avg(pow(ra - mu, 2)) AS m2, avg(pow(ra - mu, 3)) AS m3,
        avg(pow(ra - mu, 4)) AS m4, sqrt(avg(pow(least(ra, 0), 2))) AS downside_deviation,
        quantile_cont(ra, 0.05) AS historical_var FROM ret JOIN mean USING (coin_id) GROUP BY 1),
cf AS (SELECT *, m3 / pow(m2, 1.5) AS s, m4 / (m2 * m2) - 3 AS k, CAST(-1.6448536269514726 AS DOUBLE) AS z FROM mom),
wealth AS (SELECT coin_id, timestamp, product(1 + ra) OVER (PARTITION BY coin_id ORDER BY timestamp
           ROWS UNBOUNDED PRECEDING) AS w FROM ret),
peak AS (SELECT coin_id, w, greatest(1, max(w) OVER (PARTITION BY coin_id ORDER BY timestamp
         ROWS UNBOUNDED PRECEDING)) AS top FROM wealth),
dd AS (SELECT coin_id, max(1 - w / top) AS maximum_drawdown FROM peak GROUP BY 1)
--
SELECT coin_id, downside_deviation, historical_var, mu + sqrt(m2) * (z + (z*z - 1) / 6 * s + (z*z*z - 3*z) / 24 * k
       - (2*z*z*z - 5*z) / 36 * s * s) AS modified_var, maximum_drawdown FROM cf JOIN dd USING (coin_id)""",
)
def downside_risk_table(v):
    return r.downside_risk_table(_returns(v))


@query(
    "q16_capm_table",
    "coin_id beta:8 beta_down:8 beta_up:8 correlation:8",
    f"""{_RETURNS}
--
SELECT coin_id, regr_slope(ra, rb) AS beta, regr_slope(ra, rb) FILTER (rb < 0) AS beta_down,
       regr_slope(ra, rb) FILTER (rb > 0) AS beta_up, corr(ra, rb) AS correlation FROM ret GROUP BY 1""",
)
def capm_table(v):
    return r.capm_table(_returns(v))


@query(
    "q17_side_correlations",
    "coin_id corr_down:8 corr_up:8",
    f"""{_RETURNS}
--
SELECT coin_id, corr(ra, rb) FILTER (rb < 0) AS corr_down, corr(ra, rb) FILTER (rb >= 0) AS corr_up
FROM ret GROUP BY 1""",
)
def side_correlations(v):
    return r.side_correlations(_returns(v))


_TAIL = f"""{_RETURNS},
rk AS (SELECT *, row_number() OVER (PARTITION BY coin_id ORDER BY ra) AS ka,
       row_number() OVER (PARTITION BY coin_id ORDER BY rb) AS kb, count(*) OVER (PARTITION BY coin_id) AS n FROM ret
       WHERE ra IS NOT NULL AND rb IS NOT NULL),
th AS (SELECT coin_id, max(ra) FILTER (ka <= floor(n * 0.8)) AS qa, max(rb) FILTER (kb <= floor(n * 0.8)) AS qb
       FROM rk GROUP BY 1),
jt AS (SELECT coin_id, count(*) FILTER (ra > qa AND rb > qb) AS joint, count(*) AS n FROM rk JOIN th USING (coin_id)
       GROUP BY 1)"""


@query(
    "q18_tail_dependence_table",
    "coin_id tail_dependence:8",
    f"""{_TAIL}
--
SELECT coin_id, joint / (n * 0.2) AS tail_dependence FROM jt""",
)
def tail_dependence_table(v):
    return r.tail_dependence_table(_returns(v))


@query(
    "q18_tail_dependence_chibar",
    "coin_id tail_dependence:8",
    f"""{_TAIL}
--
SELECT coin_id, 2 * ln(0.2) / ln(nullif(joint, 0) / n) - 1 AS tail_dependence FROM jt""",
)
def tail_dependence_chibar(v):
    return r.tail_dependence_table(_returns(v), kind="chibar")
