"""The building blocks on their own, straight over the benchmark tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.catalog.base import query
from tidewell.catalog.charts import density_sql, histogram_sql
from tidewell.catalog.sql import friday, sunday_up, views
from tidewell.functions import calendar as cal
from tidewell.functions import names, nulls
from tidewell.operators import distribution as d
from tidewell.operators import reshape as r
from tidewell.operators.ranking import number_rows
from tidewell.sources.io import normalize_names, read_dataset, read_prices


def _orders_per_day(v):
    return v.table("orders").groupBy(cal.day("o_orderdate").alias("day"), F.col("o_orderpriority").alias("priority")).agg(
        F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("largest")
    )


_PER_DAY = """WITH pd AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS priority, count(*) AS orders,
  max(o_totalprice) AS largest FROM orders GROUP BY 1, 2)"""
_GRID = f"""{_PER_DAY}, grid AS (SELECT * FROM (SELECT DISTINCT day FROM pd), (SELECT DISTINCT priority FROM pd)),
full_pd AS (SELECT grid.*, orders, largest FROM grid LEFT JOIN pd ON grid.day = pd.day AND grid.priority = pd.priority)"""


@query(
    "p09_to_long",
    "o_orderkey measure value:4",
    """
--
SELECT l_orderkey AS o_orderkey, 'quantity' AS measure, l_quantity AS value FROM lineitem
UNION ALL SELECT l_orderkey, 'tax', l_tax FROM lineitem""",
)
def to_long(v):
    lines = v.table("lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax")
    )
    return r.to_long(lines, ["o_orderkey"], ["quantity", "tax"], "measure", "value")


@query("p12_complete_grid", "day:day priority orders:int largest:2", f"{_GRID}\n--\nSELECT * FROM full_pd")
def complete_grid(v):
    return r.complete_grid(_orders_per_day(v), "day", "priority", ["orders", "largest"])


@query(
    "p13_forward_fill",
    "day:day priority orders:int largest:2",
    f"""{_GRID}
--
SELECT day, priority, orders, last_value(largest IGNORE NULLS) OVER (PARTITION BY priority ORDER BY day
       ROWS UNBOUNDED PRECEDING) AS largest FROM full_pd""",
)
def forward_fill(v):
    grid = r.complete_grid(_orders_per_day(v), "day", "priority", ["orders", "largest"])
    return r.ffill(grid, ["priority"], ["day"], ["largest"])


@query(
    "p13_carry_to_next",
    "day:day priority largest:2",
    f"""{_GRID}, f AS (SELECT day, priority, last_value(largest IGNORE NULLS) OVER (PARTITION BY priority ORDER BY day
       ROWS UNBOUNDED PRECEDING) AS largest FROM full_pd)
--
SELECT * FROM f WHERE largest IS NOT NULL""",
)
def carry_to_next(v):
    return r.carry_to_next(_orders_per_day(v).select("day", "priority", "largest"), "priority", "day")


@query(
    "a06_share_of_total",
    "priority day:day share:10",
    f"""{_PER_DAY}
--
SELECT priority, day, orders / sum(orders) OVER () AS share FROM pd""",
)
def share_of_total(v):
    return r.share_of(_orders_per_day(v), "orders")


@query(
    "a07_count_distribution",
    "parts:int n:int",
    """
--
SELECT parts, count(*) AS n FROM (SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1) GROUP BY 1""",
)
def count_distribution(v):
    return r.count_distribution(v.table("lineitem"), "l_suppkey", "l_partkey", "parts")


@query(
    "a09_histogram_linear_by_group",
    "l_returnflag bin:int x_min:6 x_max:6 count:int frequency:9",
    histogram_sql(
        "WITH li AS (SELECT * FROM lineitem)", "li", "l_quantity", 13, log10=False, by="l_returnflag"
    ),
)
def histogram_by_group(v):
    return d.histogram(v.table("lineitem"), "l_quantity", 13, log10=False, by=["l_returnflag"])


@query(
    "a10_density_of_prices",
    "point:int x:8 density:8",
    density_sql(
        "WITH li AS (SELECT * FROM lineitem)", "li", "l_extendedprice"
    ),
)
def density_of_prices(v):
    return d.density(v.table("lineitem"), "l_extendedprice")


@query(
    "a11_ecdf_of_prices",
    "l_extendedprice:2 ecdf:9",
    """
--
SELECT DISTINCT l_extendedprice, cume_dist() OVER (ORDER BY l_extendedprice) AS ecdf FROM lineitem""",
)
def ecdf_of_prices(v):
    return d.ecdf(v.table("lineitem"), "l_extendedprice")


@query(
    "t03_top_with_ties",
    "l_suppkey:int lines:int",
    """
--
SELECT l_suppkey, count(*) AS lines FROM lineitem GROUP BY 1 QUALIFY rank() OVER (ORDER BY count(*) DESC) <= 5""",
)
def top_with_ties(v):
    counts = v.table("lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("lines"))
    return r.top_with_ties(counts, "lines", 5)


@query(
    "u_diff_unlabelled_customers",
    "c_custkey:int",
    """
--
SELECT c_custkey FROM customer EXCEPT SELECT doc_id FROM labels""",
)
def set_difference(v):
    labelled = v.table("labels").select(F.col("doc_id").alias("c_custkey"))
    return v.table("customer").select("c_custkey").subtract(labelled)


@query(
    "w06_strict_running_values",
    "day:day priority total:2 highest:2 before:8",
    f"""{_PER_DAY}, q AS (SELECT day, priority, CASE WHEN month(day) <> 6 OR day(day) <> 13 THEN largest END AS largest FROM pd)
--
SELECT day, priority, CASE WHEN count(largest) OVER w = count(*) OVER w THEN sum(largest) OVER w END AS total,
       CASE WHEN count(largest) OVER w = count(*) OVER w THEN max(largest) OVER w END AS highest,
       coalesce(CASE WHEN count(largest) OVER b = count(*) OVER b THEN product(1 + largest / 1e9) OVER b END, 1) AS before
FROM q WINDOW w AS (PARTITION BY priority ORDER BY day ROWS UNBOUNDED PRECEDING),
       b AS (PARTITION BY priority ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def running_values(v):
    """A missing value makes all later running values missing."""
    w = Window.partitionBy("priority").orderBy("day")
    known = (F.month("day") != 6) | (F.dayofmonth("day") != 13)
    return _orders_per_day(v).withColumn("largest", F.when(known, F.col("largest"))).select(
        "day", "priority",
        nulls.running_sum_strict(F.col("largest"), w).alias("total"),
        nulls.running_max_strict(F.col("largest"), w).alias("highest"),
        nulls.lagged_product_strict(1 + F.col("largest") / 1e9, w).alias("before"),
    )


@query(
    "w13_number_rows",
    "c_custkey:int rank:int",
    """
--
SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer""",
)
def number_customers(v):
    return number_rows(v.table("customer").select("c_custkey", "c_acctbal"), "-c_acctbal", "c_custkey")


@query(
    "f_weeks_of_events",
    "friday:day sunday:day events:int",
    f"""
--
SELECT {friday("ts")} AS friday, {sunday_up("ts")} AS sunday, count(*) AS events FROM events GROUP BY 1, 2""",
)
def weeks_of_events(v):
    return v.table("events").groupBy(cal.week_floor("ts").alias("friday"), cal.week_ceiling("ts").alias("sunday")).agg(
        F.count(F.lit(1)).alias("events")
    )


_PRICES = {"coin_id": "o_orderpriority", "timestamp": "o_orderdate", "vs_currency": "o_orderstatus", "price": "o_totalprice"}


@query(
    "s01_read_dataset",
    "block_timestamp:time type vault amount:4 address",
    """
--
SELECT ts AS block_timestamp, event_type AS type, props AS vault, value AS amount, CAST(user_id AS VARCHAR) AS address FROM events""",
)
def landed_dataset(v):
    """A landed table under its declared schema."""
    columns = {"block_timestamp": "ts", "type": "event_type", "vault": "props", "amount": "value", "address": "user_id"}
    return read_dataset(v.spark, "vault_events", f"{v.sf_dir}/events.parquet", columns=columns)


@query(
    "s02_price_source",
    "coin_id timestamp:day vs_currency price:8 market_cap",
    """
--
SELECT o_orderpriority AS coin_id, o_orderdate AS timestamp, o_orderstatus AS vs_currency, o_totalprice AS price,
       CAST(NULL AS DOUBLE) AS market_cap FROM orders
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'O'
AND o_orderdate >= DATE '2001-08-01' - 365 AND o_orderdate < DATE '2001-08-02'""",
)
def price_source(v):
    """Chosen coins and look-back, pushed to the scan."""
    return read_prices(
        v.spark, f"{v.sf_dir}/orders.parquet", ["1-URGENT", "2-HIGH"], 365, "2001-08-01", vs_currency="O", columns=_PRICES
    )


@query(
    "s05_normalize_names",
    "CCustkey:int CAcctbal:2",
    """
--
SELECT c_custkey AS "CCustkey", c_acctbal AS "CAcctbal" FROM customer""",
)
def renamed(v):
    return normalize_names(v.spark.read.parquet(f"{v.sf_dir}/customer.parquet"), "upper_camel")


@query(
    "p16_significant_digits",
    "c_custkey:int shown",
    """
--
SELECT c_custkey, CASE WHEN abs(x) >= 1e5 THEN printf('%.0f', x) ELSE printf('%.' || greatest(5 - floor(log10(greatest(abs(x), 1e-9)))::INT, 0) || 'f', x) END AS shown
FROM (SELECT c_custkey, floor(c_acctbal) + 0.5 * (c_custkey % 2) AS x FROM customer) WHERE abs(x) >= 1""",
)
def significant_digits(v):
    x = F.floor("c_acctbal") + 0.5 * F.pmod("c_custkey", F.lit(2))
    shown = v.table("customer").select("c_custkey", x.alias("x")).where(F.abs("x") >= 1)
    return shown.select("c_custkey", names.significant(F.col("x"), 6).alias("shown"))
