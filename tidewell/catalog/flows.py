from tidewell.catalog.base import query
from tidewell.catalog.sql import friday, n_distinct, strict_sum, views
from tidewell.plans import crossover as x
from tidewell.plans import flows as f

WEEK = "2024-01-12"
AS_OF = "2024-02-01"


def _rates(v, as_of=AS_OF):
    return f.attribute_price_day(v.vault_quotes(), v.token_dim(), as_of)


def _daily(v, mode="event_days"):
    return f.daily_valued_flows(v.vault_events(), _rates(v), mode)


def _weekly(v):
    return f.weekly_net_flows(_daily(v))


def _users(v):
    return f.weekly_new_users(v.vault_events())


@query(
    "q19_attribute_price_day",
    "coin_id timestamp:time price:4 date:day token",
    f"""{views("vault_quotes", "token_dim")},
s AS (SELECT coin_id, CASE WHEN timestamp <= TIMESTAMP '2024-01-25' THEN timestamp - INTERVAL 1 SECOND ELSE timestamp END
      AS timestamp, price FROM vault_quotes)
--
SELECT s.*, CAST(timestamp AS DATE) AS date, token FROM s LEFT JOIN token_dim USING (coin_id)""",
)
def attribute_price_day(v):
    return _rates(v, "2024-01-25")


_EVENT_DAYS = f"""{views("vault_events", "vault_rates")},
ev AS (SELECT CAST(block_timestamp AS DATE) AS date, type, vault, count(*) AS events, {strict_sum('amount')} AS amount
       FROM vault_events GROUP BY 1, 2, 3)"""

_DAILY = f"""{_EVENT_DAYS},
pr AS (SELECT ev.*, last_value(price IGNORE NULLS) OVER (PARTITION BY type, vault ORDER BY ev.date
       ROWS UNBOUNDED PRECEDING) AS price FROM ev LEFT JOIN vault_rates r ON ev.vault IS NOT DISTINCT FROM r.token AND ev.date = r.date),
daily AS (SELECT date, type, vault, events, amount, amount * price AS amount_usd FROM pr)"""


@query(
    "q20_daily_valued_flows",
    "date:day type vault events:int amount:4 amount_usd:4",
    f"""{_DAILY}
--
SELECT * FROM daily""",
)
def daily_valued_flows(v):
    return _daily(v)


@query(
    "q20_daily_valued_flows_asof",
    "date:day type vault events:int amount:4 amount_usd:4",
    f"""{_EVENT_DAYS}
--
SELECT ev.*, amount * (SELECT arg_max(price, r.date) FROM vault_rates r WHERE r.token = ev.vault AND r.date <= ev.date)
       AS amount_usd FROM ev""",
)
def daily_valued_flows_asof(v):
    return _daily(v, "asof")


_WEEKLY = f"""{_DAILY},
sg AS (SELECT {friday("date")} AS week, vault, CASE WHEN type = 'withdrawal' THEN -1 ELSE 1 END AS sgn, amount, amount_usd
       FROM daily),
wk AS (SELECT week, vault, {strict_sum("sgn * amount")} AS net_deposits, {strict_sum("sgn * amount_usd")} AS net_deposits_usd
       FROM sg GROUP BY 1, 2),
weekly AS (SELECT *, CASE WHEN count(net_deposits) OVER w = count(*) OVER w THEN sum(net_deposits) OVER w END AS deposits_to_date,
       CASE WHEN count(net_deposits_usd) OVER w = count(*) OVER w THEN sum(net_deposits_usd) OVER w END AS deposits_usd_to_date
       FROM wk WINDOW w AS (PARTITION BY vault ORDER BY week ROWS UNBOUNDED PRECEDING))"""


@query(
    "q21_weekly_net_flows",
    "week:day vault net_deposits:4 net_deposits_usd:4 deposits_to_date:4 deposits_usd_to_date:4",
    f"""{_WEEKLY}
--
SELECT * FROM weekly""",
)
def weekly_net_flows(v):
    return _weekly(v)


@query(
    "q22_cumulative_vs_benchmark",
    "week:day vault type usd:4",
    f"""{_WEEKLY}
--
SELECT week, vault, 'value' AS type, deposits_usd_to_date AS usd FROM weekly
UNION ALL SELECT w.week, w.vault, 'benchmark', CASE WHEN w.week >= DATE '{WEEK}' THEN b.deposits_usd_to_date END
FROM weekly w LEFT JOIN (SELECT vault, deposits_usd_to_date FROM weekly WHERE week = DATE '{WEEK}') b ON w.vault IS NOT DISTINCT FROM b.vault""",
)
def cumulative_vs_benchmark(v):
    return f.cumulative_vs_benchmark(_weekly(v), WEEK)


@query(
    "q23_net_flows_since",
    "week:day vault net_deposits_usd:4",
    f"""{_WEEKLY}
--
SELECT week, vault, net_deposits_usd FROM weekly WHERE week >= DATE '{WEEK}'""",
)
def net_flows_since(v):
    return f.net_flows_since(_weekly(v), WEEK)


_USERS = f"""{views("vault_events")},
dep AS (SELECT *, {friday("block_timestamp")} AS week FROM vault_events WHERE type = 'deposit'),
act AS (SELECT DISTINCT vault, week FROM dep),
cum AS (SELECT act.vault, act.week, count(DISTINCT dep.address) AS distinct_users FROM act JOIN dep
        ON dep.vault IS NOT DISTINCT FROM act.vault AND dep.week <= act.week GROUP BY 1, 2),
users AS (SELECT *, distinct_users - lag(distinct_users, 1, 0) OVER (PARTITION BY vault ORDER BY week) AS new_users FROM cum)"""


@query(
    "q24_weekly_new_users",
    "vault week:day distinct_users:int new_users:int",
    f"""{_USERS}
--
SELECT * FROM users""",
)
def weekly_new_users(v):
    return _users(v)


@query(
    "q25_new_users_since",
    "vault week:day new_users:int cumulative_new_users:int",
    f"""{_USERS}
--
SELECT vault, week, new_users, sum(new_users) OVER (PARTITION BY vault ORDER BY week) AS cumulative_new_users
FROM users WHERE week >= DATE '{WEEK}'""",
)
def new_users_since(v):
    return f.new_users_since(_users(v), WEEK)


@query(
    "q26_vaults_per_wallet",
    "vaults:int n:int percentage:9",
    f"""{views("vault_events")},
c AS (SELECT address, {n_distinct('vault')} AS vaults FROM vault_events GROUP BY 1)
--
SELECT vaults, count(*) AS n, count(*) / sum(count(*)) OVER () AS percentage FROM c GROUP BY 1""",
)
def vaults_per_wallet(v):
    return f.vaults_per_wallet(v.vault_events())


_NODES = f"""{views("vault_events")},
dep AS (SELECT *, min(block_timestamp) OVER (PARTITION BY address) AS first FROM vault_events WHERE type = 'deposit'),
nd AS (SELECT vault, count(DISTINCT address) AS depositors, count(*) FILTER (block_timestamp = first) AS first_depositors
       FROM dep GROUP BY 1),
nodes AS (SELECT row_number() OVER (ORDER BY vault NULLS FIRST) AS id, * FROM nd)"""


def _edges_sql(base: str) -> str:
    return f"""{_NODES},
fd AS (SELECT address, vault, min(block_timestamp) AS t FROM dep GROUP BY 1, 2),
wt AS (SELECT a.vault AS from_vault, b.vault AS to_vault, count(*) AS weight FROM fd a JOIN fd b
       ON a.address = b.address AND a.vault IS DISTINCT FROM b.vault AND a.t < b.t GROUP BY 1, 2),
edges AS (SELECT n.id AS "from", m.id AS "to", weight, weight / n.{base} AS percentage_weight, from_vault, to_vault
          FROM wt JOIN nodes n ON n.vault IS NOT DISTINCT FROM from_vault JOIN nodes m ON m.vault IS NOT DISTINCT FROM to_vault)"""


def _edges(v, base="depositors"):
    events = v.vault_events()
    return x.directed_crossover(events, x.crossover_nodes(events), base)


@query(
    "q27_crossover_nodes",
    "id:int vault depositors:int first_depositors:int",
    f"""{_NODES}
--
SELECT * FROM nodes""",
)
def crossover_nodes(v):
    return x.crossover_nodes(v.vault_events())


@query(
    "q28_directed_crossover",
    "from:int to:int weight:int percentage_weight:9 from_vault to_vault",
    f"""{_edges_sql("depositors")}
--
SELECT * FROM edges""",
)
def directed_crossover(v):
    return _edges(v)


@query(
    "q28_directed_crossover_by_first_depositors",
    "from:int to:int weight:int percentage_weight:9 from_vault to_vault",
    f"""{_edges_sql("first_depositors")}
--
SELECT * FROM edges""",
)
def directed_crossover_by_first_depositors(v):
    return _edges(v, "first_depositors")


@query(
    "q29_undirected_crossover",
    "first:int second:int vault_1 vault_2 weight:int",
    f"""{_edges_sql("depositors")},
u AS (SELECT least("from", "to") AS first, greatest("from", "to") AS second, sum(weight) AS weight FROM edges GROUP BY 1, 2)
--
SELECT u.*, n.vault AS vault_1, m.vault AS vault_2 FROM u JOIN nodes n ON n.id = first JOIN nodes m ON m.id = second""",
)
def undirected_crossover(v):
    return x.undirected_crossover(_edges(v))


@query(
    "q30_graph_export_nodes",
    "id:int zero_based_id:int label size:8 title",
    f"""{_NODES}
--
SELECT id, id - 1 AS zero_based_id, vault AS label, 3 * ln(first_depositors) AS size,
       vault || ' vault, First depositors: ' || first_depositors AS title FROM nodes""",
)
def graph_export_nodes(v):
    return x.export_nodes(x.crossover_nodes(v.vault_events()), "first_depositors")


@query(
    "q30_graph_export_edges",
    "from:int to:int source:int target:int width:8 percentage:7 title",
    f"""{_edges_sql("depositors")}
--
SELECT "from", "to", "from" - 1 AS source, "to" - 1 AS target, weight / 30 AS width,
       percentage_weight * 100 AS percentage, from_vault || ' to ' || to_vault || ': ' || weight AS title FROM edges""",
)
def graph_export_edges(v):
    return x.export_edges(_edges(v))
