from tidewell.catalog.base import query
from tidewell.catalog.charts import histogram_sql
from tidewell.catalog.sql import n_distinct, sunday_up, views
from tidewell.plans import focus
from tidewell.plans import upstream as u
from tidewell.plans import whales as w


def _whales(v):
    return u.identify_whales(v.accounts(), v.labels())


def _swaps(v):
    return u.whale_swaps(v.swaps(), _whales(v))


@query(
    "q52_balance_summary",
    "count:int max_balance:4 avg_balance:4 median_balance:4 min_balance:4",
    f"""{views("whales")}
--
SELECT count(*) AS count, max(balance) AS max_balance, avg(balance) AS avg_balance, median(balance) AS median_balance,
       min(balance) AS min_balance FROM whales""",
)
def balance_summary(v):
    return w.balance_summary(_whales(v))


@query(
    "q52_wallet_listing",
    "address balance:4",
    f"""{views("whales")}
--
SELECT * FROM whales""",
)
def wallet_listing(v):
    return w.wallet_listing(_whales(v))


@query(
    "q53_participation",
    "has_swapped count:int percentage:9",
    f"""{views("whales", "swaps")},
a AS (SELECT address, address IN (SELECT swapper FROM swaps WHERE block_timestamp >= TIMESTAMP '2001-01-01') AS yes FROM whales)
--
SELECT CASE WHEN yes THEN 'yes' ELSE 'no' END AS has_swapped, count(*) AS count,
       count(*) / (SELECT count(*) FROM whales) AS percentage FROM a GROUP BY 1""",
)
def participation(v):
    """Whales that swapped since the start of the last full year."""
    whales = _whales(v)
    return w.participation(whales, u.whale_swaps(v.swaps(), whales, since="2001-01-01"))


@query(
    "q54_swaps_per_whale",
    "bin:int x_min:8 x_max:8 count:int frequency:9",
    histogram_sql(
        f"{views('whale_swaps')}, s AS (SELECT swapper, count(*) AS swaps FROM whale_swaps GROUP BY 1)",
        "s", "swaps", 40, log10=False,
    ),
)
def swaps_per_whale(v):
    return w.swaps_per_whale(_swaps(v))


_SIDES = f"""{views("whale_swaps")},
f AS (SELECT swap_from_name AS asa, count(DISTINCT swapper) AS wf, count(*) AS swaps_from FROM whale_swaps GROUP BY 1),
t AS (SELECT swap_to_name AS asa, count(DISTINCT swapper) AS wt, count(*) AS swaps_to FROM whale_swaps GROUP BY 1)"""


@query(
    "q55_asset_flow_summary",
    "asa whales:int swaps_from:int swaps_to:int swaps:int",
    f"""{_SIDES}
--
SELECT f.asa, wf + wt AS whales, swaps_from, swaps_to, swaps_from + swaps_to AS swaps FROM f LEFT JOIN t ON f.asa IS NOT DISTINCT FROM t.asa""",
)
def asset_flow_summary(v):
    return w.asset_flow_summary(_swaps(v))


@query(
    "q55_asset_flow_summary_full",
    "asa whales:int swaps_from:int swaps_to:int swaps:int",
    f"""{_SIDES}
--
SELECT coalesce(f.asa, t.asa) AS asa, wf + wt AS whales, swaps_from, swaps_to, swaps_from + swaps_to AS swaps FROM f FULL JOIN t ON coalesce(f.asa, '') = coalesce(t.asa, '')""",
)
def asset_flow_summary_full(v):
    return w.asset_flow_summary(_swaps(v), "full")


def _dense_sql(side: str) -> str:
    asset = f"swap_{side}_name"
    return f"""{views("whale_swaps")},
wk AS (SELECT *, {sunday_up("block_timestamp")} AS week FROM whale_swaps),
c AS (SELECT week, {asset}, count(DISTINCT swapper) AS whales, count(*) AS swaps FROM wk GROUP BY 1, 2),
g AS (SELECT * FROM (SELECT DISTINCT week FROM wk), (SELECT DISTINCT {asset} FROM wk))
--
SELECT g.week, g.{asset}, whales, coalesce(swaps, 0) AS swaps FROM g LEFT JOIN c ON g.week = c.week AND g.{asset} IS NOT DISTINCT FROM c.{asset}"""


@query("q56_weekly_dense_counts_from", "week:day swap_from_name whales:int swaps:1", _dense_sql("from"))
def weekly_from(v):
    return w.weekly_dense_counts(_swaps(v), "from")


@query("q56_weekly_dense_counts_to", "week:day swap_to_name whales:int swaps:1", _dense_sql("to"))
def weekly_to(v):
    return w.weekly_dense_counts(_swaps(v), "to")


@query(
    "q57_focus_groups",
    "value label",
    f"""{views("swaps")},
named AS (SELECT * FROM (VALUES ('ASA3', 'red'), ('ASA1', 'blue'), ('ASA99', 'green')) AS t(value, label)),
rest AS (SELECT value, row_number() OVER (ORDER BY value NULLS FIRST) AS k FROM (SELECT DISTINCT swap_to_name AS value FROM swaps)
         WHERE value IS NULL OR value NOT IN (SELECT value FROM named))
--
SELECT * FROM named UNION ALL SELECT value, CASE (k - 1) % 2 WHEN 0 THEN 'grey' ELSE 'black' END FROM rest""",
)
def focus_groups(v):
    return focus.focus_groups(
        v.swaps(), "swap_to_name", ["ASA3", "ASA1", "ASA99"], ["red", "blue", "green", "grey", "black"]
    )


@query(
    "q57_mapping_by_id",
    "swap_to_asset_id value label",
    f"""{views("swaps")}
--
SELECT DISTINCT swap_to_asset_id, swap_to_name AS value, CASE swap_to_name WHEN 'ASA3' THEN 'red' WHEN 'ASA1' THEN 'blue' END AS label FROM swaps""",
)
def mapping_by_id(v):
    named = v.spark.createDataFrame([("ASA3", "red"), ("ASA1", "blue")], "value string, label string")
    return focus.mapping_by_id(v.swaps(), "swap_to_asset_id", "swap_to_name", named)


@query(
    "q57_unmatched_values",
    "value",
    f"""{views("swaps")}
--
SELECT * FROM (VALUES ('ASA3'), ('ASA99')) AS t(value) WHERE value NOT IN (SELECT swap_to_name FROM swaps WHERE swap_to_name IS NOT NULL)""",
)
def unmatched_values(v):
    return focus.unmatched_values(v.swaps(), "swap_to_name", ["ASA3", "ASA99"])


@query(
    "q57_ambiguous_ids",
    "swapper n_values:int",
    f"""{views("swaps")}
--
SELECT swapper, {n_distinct('swap_to_name')} AS n_values FROM swaps GROUP BY 1 HAVING {n_distinct('swap_to_name')} > 1""",
)
def ambiguous_ids(v):
    return focus.ambiguous_ids(v.swaps(), "swapper", "swap_to_name")
