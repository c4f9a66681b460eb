"""Long series in blocks, sketches, landed layouts and displays."""

from pyspark.sql import functions as F

from tidewell.catalog.base import query
from tidewell.catalog.core import _PRICES
from tidewell.catalog.sql import friday, views
from tidewell.functions import calendar as cal
from tidewell.functions import names
from tidewell.operators import series, sketches
from tidewell.plans import popularity as pop
from tidewell.plans import upstream as u
from tidewell.sources import io

#: Orders by status are a few long series; prices are missing on the last ones of a status, and mostly in ``seen``.
_LONG = """WITH q AS (SELECT o_orderstatus AS status, o_orderkey, CASE WHEN o_orderkey % 50000 <> 49999 THEN o_totalprice END AS price,
  CASE WHEN o_orderkey % 9 = 4 THEN o_totalprice END AS seen FROM orders)"""


def _long(v):
    key = F.col("o_orderkey")
    return v.table("orders").select(
        F.col("o_orderstatus").alias("status"),
        "o_orderkey",
        F.when(F.pmod(key, F.lit(50000)) != 49999, F.col("o_totalprice")).alias("price"),
        F.when(F.pmod(key, F.lit(9)) == 4, F.col("o_totalprice")).alias("seen"),
    )


@query(
    "w06_running_values_of_long_series",
    "status o_orderkey:int total:2 highest:2 before:6",
    f"""{_LONG}
--
SELECT status, o_orderkey, CASE WHEN count(price) OVER w = count(*) OVER w THEN sum(price) OVER w END AS total,
       CASE WHEN count(price) OVER w = count(*) OVER w THEN max(price) OVER w END AS highest,
       coalesce(CASE WHEN count(price) OVER b = count(*) OVER b THEN product(1 + price / 1e12) OVER b END, 1) AS before
FROM q WINDOW w AS (PARTITION BY status ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING),
       b AS (PARTITION BY status ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def running_values_of_long_series(v):
    """Running sum, maximum and lagged product of series that are too long for one task."""
    rows = _long(v).withColumn("factor", 1 + F.col("price") / 1e12)
    return series.running(
        rows, ["status"], ["o_orderkey"], {"total": ("sum", "price"), "highest": ("max", "price"), "before": ("product_before", "factor")}
    )


@query(
    "p13_forward_fill_of_long_series",
    "status o_orderkey:int seen:2",
    f"""{_LONG}
--
SELECT status, o_orderkey, last_value(seen IGNORE NULLS) OVER (PARTITION BY status ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS seen FROM q""",
)
def forward_fill_of_long_series(v):
    return series.ffill_long(_long(v).select("status", "o_orderkey", "seen"), ["status"], ["o_orderkey"], ["seen"])


@query(
    "a15_worst_fall_of_long_series",
    "status fall:6",
    f"""{_LONG}, f AS (SELECT status, o_orderkey, 1 + (price - 150000) / 1e8 AS factor FROM q WHERE price IS NOT NULL),
w AS (SELECT status, o_orderkey, product(factor) OVER (PARTITION BY status ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS level FROM f)
--
SELECT status, max(1 - level / top) AS fall FROM (SELECT status, level,
  greatest(max(level) OVER (PARTITION BY status ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 1) AS top FROM w) GROUP BY 1""",
)
def worst_fall_of_long_series(v):
    rows = _long(v).withColumn("factor", 1 + (F.col("price") - 150000) / 1e8)
    return series.worst_fall(rows, ["status"], ["o_orderkey"], "factor")


@query(
    "a03_distinct_by_sketches",
    "vault week:day near",
    f"""{views("vault_events")},
w AS (SELECT DISTINCT vault, {friday("block_timestamp")} AS week FROM vault_events)
--
SELECT vault, week, true AS near FROM w""",
)
def distinct_by_sketches(v):
    """Users of each vault up to each week from stored weekly sketches, and whether they are within 5 percent of the exact number."""
    events = v.vault_events().withColumn("week", cal.week_floor("block_timestamp"))
    about = sketches.running_distinct(sketches.distinct_sketches(events, "address", ["vault", "week"]), ["vault"], "week", "about")
    first = events.groupBy("vault", "address").agg(F.min("week").alias("week")).groupBy("vault", "week").agg(F.count("address").alias("new"))
    weeks = events.select("vault", "week").distinct()
    known = _all_weeks(weeks, first)
    exact = series.running(known, ["vault"], ["week"], {"exact": ("sum", "new")}, block=F.date_trunc("year", "week"))
    both = series.left_join_null_safe(about, exact, ["vault", "week"])
    return both.select("vault", "week", (F.abs(F.col("about") - F.col("exact")) <= 0.05 * F.col("exact")).alias("near"))


def _all_weeks(weeks, first):
    """Weeks without a new user count 0."""
    return series.left_join_null_safe(weeks, first, ["vault", "week"]).withColumn("new", F.coalesce("new", F.lit(0)))


_PROBS = [0.1, 0.5, 0.9, 0.99]


@query(
    "a19_quantiles_by_sketches",
    "l_returnflag prob:2 near",
    """
--
SELECT l_returnflag, prob, true AS near FROM (SELECT DISTINCT l_returnflag FROM lineitem), (VALUES (0.1), (0.5), (0.9), (0.99)) AS p(prob)""",
)
def quantiles_by_sketches(v):
    """Quantiles per flag from sketches of each month merged, and whether their rank is within 2 percent."""
    lines = v.table("lineitem").select("l_returnflag", "l_extendedprice", F.date_trunc("month", "l_shipdate").alias("month"))
    stored = sketches.quantile_sketches(lines, "l_extendedprice", ["l_returnflag", "month"])
    about = sketches.picked_quantiles(sketches.merged_quantiles(stored, ["l_returnflag"]), _PROBS)
    # the share of rows at or below each of the few values, in one pass
    placed = lines.join(F.broadcast(about), "l_returnflag").groupBy("l_returnflag", "prob").agg(
        F.avg((F.col("l_extendedprice") <= F.col("quantile")).cast("double")).alias("rank")
    )
    return placed.select("l_returnflag", "prob", (F.abs(F.col("rank") - F.col("prob")) <= 0.02).alias("near"))


@query(
    "s02_landed_prices",
    "coin_id timestamp:day vs_currency price:8 market_cap",
    """
--
SELECT o_orderpriority AS coin_id, o_orderdate AS timestamp, o_orderstatus AS vs_currency, o_totalprice AS price,
       CAST(NULL AS DOUBLE) AS market_cap FROM orders
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'O'
AND o_orderdate >= DATE '2001-08-01' - 365 AND o_orderdate < DATE '2001-08-02'""",
)
def landed_prices(v):
    """Prices landed by coin and month, and the chosen coins and look-back read from the folders they are in."""
    path = io.shared_folder(v.spark)
    io.land_prices(io.read_dataset(v.spark, "price_history", f"{v.sf_dir}/orders.parquet", columns=_PRICES), path)
    return io.read_landed_prices(v.spark, path, ["1-URGENT", "2-HIGH"], 365, "2001-08-01", vs_currency="O")


@query(
    "s04_refreshed_days",
    "day:day orders:int",
    """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)
--
SELECT day, CASE WHEN day >= DATE '2001-06-01' THEN n ELSE -n END AS orders FROM d""",
)
def refreshed_days(v):
    """A table by month, of which a later run writes the last days anew; read back."""
    daily = v.table("orders").groupBy(cal.day("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("orders"))
    monthly = daily.withColumn("month", F.date_trunc("month", "day").cast("date"))
    path = io.shared_folder(v.spark)
    io.refresh_days(monthly.withColumn("orders", -F.col("orders")), path, "month")
    for _ in range(2):  # a repeated run changes nothing
        io.refresh_days(monthly.where(F.col("month") >= F.lit("2001-06-01").cast("date")), path, "month")
    return v.spark.read.parquet(path).select("day", "orders")


@query(
    "f_displays",
    "n_nationkey:int share value whole",
    """WITH t AS (SELECT c_nationkey AS n_nationkey, count(*) AS n, floor(sum(c_acctbal)) - 3000000 * (c_nationkey % 2) AS value FROM customer GROUP BY 1)
--
SELECT n_nationkey, printf('%.1f', 100 * floor(1000 * n / (SELECT sum(n) FROM t)) / 1000) || '%' AS share,
       CASE WHEN value < 0 THEN '-$' ELSE '$' END || format('{:,}', CAST(abs(value) AS BIGINT)) AS value, format('{:,}', n * 1000) AS whole FROM t""",
)
def displays(v):
    """Shares as percent, values in dollars, counts with commas."""
    value = F.floor(F.sum("c_acctbal")) - 3000000 * F.pmod(F.col("c_nationkey"), F.lit(2))
    per = v.table("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), value.alias("value"))
    share = F.floor(1000 * F.col("n") / per.agg(F.sum("n")).scalar()) / 1000
    return per.select(
        F.col("c_nationkey").alias("n_nationkey"),
        names.percent(share, 1).alias("share"),
        names.dollar(F.col("value")).alias("value"),
        F.format_number(F.col("n") * 1000, 0).alias("whole"),
    )


@query(
    "p15_rank_matrix_of_pulled_names",
    "rank:int algofi pactfi tinyman",
    f"""{views("asset_popularity_by_dex")}
--
SELECT rank, max(asset_name) FILTER (swap_program = 'algofi') AS algofi, max(asset_name) FILTER (swap_program = 'pactfi') AS pactfi,
       max(asset_name) FILTER (swap_program = 'tinyman') AS tinyman FROM asset_popularity_by_dex WHERE rank <= 5 GROUP BY 1""",
)
def rank_matrix_of_pulled_names(v):
    """The exchanges that become columns are pulled from the data, a bounded number of them."""
    return pop.top_assets_by_dex(u.asset_popularity(v.swaps(), by_dex=True, n=5), 5, wide=True)
