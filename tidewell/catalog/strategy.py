from tidewell.catalog.base import query
from tidewell.catalog.sql import friday, views
from tidewell.plans import strategy as s

MULT = 1.05
SINCE = "1996-01-01"

_OPEN = f"""{views("price_history")},
o AS (SELECT *, coalesce(lag(price) OVER (PARTITION BY coin_id ORDER BY timestamp), price) AS prev,
      {friday("timestamp")} AS week FROM price_history),
w AS (SELECT *, first_value(prev) OVER (PARTITION BY coin_id, week ORDER BY timestamp) AS open FROM o),
k AS (SELECT *, round_even(open * CAST({MULT} AS DOUBLE) * 2, 0) / 2 AS simulated_strike FROM w),
b AS (SELECT *, simulated_strike / price - 1 AS breakeven FROM k)"""


@query(
    "q01_level_days",
    "coin_id days:int days_above:int days_below:int",
    f"""{views("price_history")}
--
SELECT coin_id, count(*) AS days, count(*) FILTER (price >= 62) AS days_above,
       count(*) FILTER (price < 62) AS days_below FROM price_history GROUP BY 1""",
)
def level_days(v):
    return s.level_days(v.price_history(), 62.0)


@query(
    "q02_price_window",
    "coin_id timestamp:day price:8",
    f"""{views("price_history")}
--
SELECT coin_id, timestamp, price FROM price_history WHERE timestamp >= DATE '{SINCE}'""",
)
def price_window(v):
    return s.price_window(v.price_history(), SINCE)


_LONG = f"""{_OPEN},
long AS (SELECT coin_id, timestamp, week, breakeven, 'price' AS type, price AS value FROM b
         UNION ALL SELECT coin_id, timestamp, week, breakeven, 'simulated_strike', simulated_strike FROM b)"""


@query(
    "q03_weekly_strikes",
    "coin_id timestamp:day week:day breakeven:9 type value:8",
    f"""{_LONG}
--
SELECT * FROM long WHERE timestamp >= DATE '{SINCE}'""",
)
def weekly_strikes(v):
    return s.weekly_strikes(v.price_history(), MULT, since=SINCE)


@query(
    "q04_strike_breaches",
    "coin_id weeks:int breaches:int",
    f"""{_OPEN}
--
SELECT coin_id, count(*) AS weeks, sum(CASE WHEN last < 0 THEN 1 ELSE 0 END) AS breaches FROM
  (SELECT coin_id, week, arg_max(breakeven, timestamp) AS last FROM b GROUP BY 1, 2) GROUP BY 1""",
)
def strike_breaches(v):
    return s.strike_breaches(v.price_history(), MULT)


def _portfolio(premium: float, n: str = "") -> str:
    """Portfolio views for one premium, suffixed with ``n``."""
    return f"""r{n} AS (SELECT *, least(price / open - 1, 0.15) + {premium} AS ret,
      100 * price / first_value(price) OVER (PARTITION BY coin_id ORDER BY timestamp) AS hold_portfolio FROM w),
l{n} AS (SELECT coin_id, week, coalesce(product(m) OVER (PARTITION BY coin_id ORDER BY week
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS level
      FROM (SELECT coin_id, week, 1 + arg_max(ret, timestamp) AS m FROM r{n} GROUP BY 1, 2)),
p{n} AS (SELECT r.coin_id, r.timestamp, r.week, r.ret AS covered_call_returns,
      100 * level * (1 + ret) AS covered_call_portfolio, hold_portfolio
      FROM r{n} AS r JOIN l{n} AS l ON r.coin_id = l.coin_id AND r.week = l.week)"""


@query(
    "q05_covered_call_portfolio",
    "coin_id timestamp:day week:day covered_call_returns:8 covered_call_portfolio:8 hold_portfolio:6",
    f"""{_OPEN}, {_portfolio(0.0)}
--
SELECT * FROM p""",
)
def covered_call_portfolio(v):
    return s.covered_call_portfolio(v.price_history())


@query(
    "q05_covered_call_portfolio_since",
    "coin_id timestamp:day week:day covered_call_returns:8 covered_call_portfolio:8 hold_portfolio:6",
    f"""{_OPEN.replace("FROM price_history)", f"FROM price_history WHERE timestamp >= DATE '{SINCE}')")}, {_portfolio(0.01)}
--
SELECT * FROM p""",
)
def covered_call_portfolio_since(v):
    """Cut first: the portfolio starts on the first day shown, and earns a premium."""
    return s.covered_call_portfolio(v.price_history(), premium=0.01, since=SINCE)


@query(
    "q06_portfolio_summary",
    "coin_id weeks:int hold_return:8 covered_call_return:8 weeks_behind:int average_shortfall:8 breakeven_yield:8",
    f"""{_OPEN}, {_portfolio(0.0)},
e AS (SELECT coin_id, week, arg_max(hold_portfolio, timestamp) AS h, arg_max(covered_call_portfolio, timestamp) AS c
      FROM p GROUP BY 1, 2),
g AS (SELECT *, h / lag(h, 1, 100.0) OVER x AS hg, c / lag(c, 1, 100.0) OVER x AS cg FROM e
      WINDOW x AS (PARTITION BY coin_id ORDER BY week)),
t AS (SELECT coin_id, count(*) AS weeks, arg_max(h, week) / 100 - 1 AS hold_return,
      arg_max(c, week) / 100 - 1 AS covered_call_return, count(*) FILTER (hg - cg > 1e-12) AS weeks_behind,
      sum(CASE WHEN hg - cg > 1e-12 THEN cg - hg ELSE 0 END) AS shortfall FROM g GROUP BY 1)
--
SELECT coin_id, weeks, hold_return, covered_call_return, weeks_behind,
       shortfall / nullif(weeks_behind, 0) AS average_shortfall,
       pow((1 + hold_return) / (1 + covered_call_return), 1.0 / weeks) - 1 AS breakeven_yield FROM t""",
)
def portfolio_summary(v):
    return s.portfolio_summary(s.covered_call_portfolio(v.price_history()), tolerance=1e-12)


@query(
    "q07_premium_sensitivity",
    "coin_id timestamp:day portfolio value:6",
    f"""{_OPEN}, {_portfolio(0.005, "1")}, {_portfolio(0.02, "2")}
--
SELECT coin_id, timestamp, 'covered_call_0.50pct' AS portfolio, covered_call_portfolio AS value FROM p1
UNION ALL SELECT coin_id, timestamp, 'covered_call_2.00pct', covered_call_portfolio FROM p2
UNION ALL SELECT coin_id, timestamp, 'hold', hold_portfolio FROM p1""",
)
def premium_sensitivity(v):
    return s.premium_sensitivity(v.price_history())


@query(
    "q08_rolling_return",
    "coin_id timestamp:day rolling_return:8 threshold:4",
    f"""{views("price_history")}
--
SELECT * FROM (SELECT coin_id, timestamp, price / lag(price, 6) OVER (PARTITION BY coin_id ORDER BY timestamp) - 1
  AS rolling_return, 0.15 AS threshold FROM price_history) WHERE timestamp >= DATE '1995-01-05'""",
)
def rolling_return(v):
    return s.rolling_return(v.price_history(), since="1995-01-05")


@query(
    "q09_strike_segments",
    "coin_id x:day x_end:day y:4",
    f"""{_LONG}
--
SELECT coin_id, lag(timestamp) OVER (PARTITION BY coin_id ORDER BY timestamp) AS x, timestamp AS x_end, value AS y
FROM long WHERE type = 'simulated_strike' AND timestamp >= DATE '{SINCE}'""",
)
def strike_segments(v):
    return s.strike_segments(s.weekly_strikes(v.price_history(), MULT, since=SINCE))
