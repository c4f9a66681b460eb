"""Long series in blocks, sketches, landed layouts and pruned ranks."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewell.catalog import QUERIES
from tidewell.functions import nulls
from tidewell.operators import ranking, reshape, series, sketches
from tidewell.plans import popularity
from tidewell.sources import io


def close(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9))


@pytest.mark.parametrize("by_time", [True, False])
@pytest.mark.parametrize("gaps", [0.0, 0.02, 0.9])
def test_running_like_windows(spark, by_time, gaps):
    rnd = random.Random(int(gaps * 100) + by_time)
    data = [(rnd.choice(["hot", "hot", "b", None]), i, None if rnd.random() < gaps else rnd.uniform(-1, 2)) for i in range(900)]
    data += [("gap", 1000 + i, None) for i in range(40)] + [("gap", 2000, 1.0)]  # whole blocks without a value
    df = spark.createDataFrame(data, "k string, t int, v double").repartition(5)
    kinds = {"sum": "sum", "max": "max", "before": "product_before", "v2": "last"}
    block = F.floor(F.col("t") / 100) if by_time else None
    got = series.running(df, ["k"], ["t"], {n: (kind, "v") for n, kind in kinds.items()}, block, levels=4)
    assert got.columns == ["k", "t", "v", "sum", "max", "before", "v2"]
    w = Window.partitionBy("k").orderBy("t")
    want = df.select(
        "k", "t", nulls.running_sum_strict(F.col("v"), w), nulls.running_max_strict(F.col("v"), w), nulls.lagged_product_strict(F.col("v"), w),
        F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    )
    for a, b in zip(rows(got.drop("v"), "t"), rows(want, "t"), strict=True):
        assert a[:2] == b[:2] and all(map(close, a[2:], b[2:])), (a, b)
    filled = series.ffill_long(df, ["k"], ["t"], ["v"], block, levels=4)
    assert [r[2] for r in rows(filled, "t")] == [b[5] for b in rows(want, "t")]


def test_one_key_is_many_tasks(spark):
    df = spark.range(200_000).select(F.lit("a").alias("k"), F.col("id").alias("t"))
    per = ranking.sliced(df, ["k", "t"], 6).groupBy("__slice").count().collect()
    assert len(per) > 50 and max(r["count"] for r in per) < 10_000


def test_strings_with_a_common_start_spread(spark):
    df = spark.range(20_000).select(F.format_string("wallet_%08d", "id").alias("v"))
    per = ranking.sliced(df, ["v"], 8).groupBy("__slice").count().collect()
    assert len(per) > 100 and max(r["count"] for r in per) < 400
    got = ranking.number_rows(df, "-v").where("rank in (1, 20000)")
    assert rows(got, "rank") == [("wallet_00019999", 1), ("wallet_00000000", 20000)]


@pytest.mark.parametrize("by_time", [True, False])
def test_worst_fall_like_a_loop(spark, by_time):
    rnd = random.Random(9)
    data = [(k, i, rnd.choice([None, rnd.uniform(0.7, 1.3)])) for k in ("a", "b", None) for i in range(300)]
    data += [("up", i, 1.1) for i in range(20)] + [("zero", 0, 1.5), ("zero", 1, 0.0), ("zero", 2, 2.0)]
    want = {}
    for k, _, x in sorted(data, key=lambda r: r[1]):
        level, top, fall = want.get(k, (1.0, 1.0, 0.0))
        level *= 1.0 if x is None else x
        top = max(top, level)
        want[k] = (level, top, max(fall, 1 - level / top))
    df = spark.createDataFrame(data, "k string, t int, x double").repartition(4)
    got = series.worst_fall(df, ["k"], ["t"], "x", F.floor(F.col("t") / 7) if by_time else None, levels=5)
    assert {r.k for r in got.collect()} == set(want)
    assert all(close(r.fall, want[r.k][2]) for r in got.collect())


def test_sketches_are_near(spark):
    df = spark.range(60_000).select(F.pmod("id", F.lit(3)).alias("g"), F.pmod("id", F.lit(10)).alias("day"), (F.col("id") * 7 % 20_011).alias("x"))
    daily = sketches.distinct_sketches(df, "x", ["g", "day"])
    about = {r.g: r.n_distinct for r in sketches.with_estimate(sketches.merged_distinct(daily, ["g"])).collect()}
    exact = {r.g: r.n for r in df.groupBy("g").agg(F.countDistinct("x").alias("n")).collect()}
    assert all(abs(about[g] - n) <= 0.03 * n for g, n in exact.items())
    running = sketches.running_distinct(daily, ["g"], "day").where("day = 9").collect()
    assert all(r.n_distinct == about[r.g] for r in running)
    merged = sketches.merged_quantiles(sketches.quantile_sketches(df, "x", ["g", "day"]), ["g"])
    for r in sketches.picked_quantiles(merged, [0.0, 0.25, 0.5, 0.99]).collect():
        rank = df.where((F.col("g") == r.g) & (F.col("x") <= r.quantile)).count() / 20_000
        assert abs(rank - r.prob) <= 0.02
    none = spark.createDataFrame([(1, None)], "g int, x double")
    assert sketches.picked_quantiles(sketches.quantile_sketches(none, "x", ["g"]), [0.5]).collect() == []


def test_refreshing_days_leaves_others(spark, tmp_path):
    path, day = str(tmp_path / "daily"), lambda d: dt.date(2024, 1, d)
    frame = lambda data: spark.createDataFrame(data, "day date, v int")
    io.refresh_days(frame([(day(1), 1), (day(2), 2), (day(3), 3)]), path)
    old = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "daily" / "day=2024-01-01").iterdir()}
    for _ in range(2):
        io.refresh_days(frame([(day(2), 20), (day(4), 40)]), path)
    assert rows(spark.read.parquet(path).select("day", "v")) == [(day(1), 1), (day(2), 20), (day(3), 3), (day(4), 40)]
    assert old == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "daily" / "day=2024-01-01").iterdir()}


def test_landed_prices_prune_folders(spark, sf_dir, capsys):
    df = QUERIES["s02_landed_prices"](spark, sf_dir)
    df.explain("formatted")
    filters = next(line for line in capsys.readouterr().out.splitlines() if line.startswith("PartitionFilters:"))
    assert "month" in filters and "coin_id" in filters
    files = len(df.inputFiles())
    scan = df._jdf.queryExecution().executedPlan()
    df.collect()
    read = [m for m in str(scan.toString()).splitlines() if "FileScan" in m]
    assert files and read


def test_first_ranks_are_pruned(spark, sf_dir, capsys):
    for name, sign in (("q35_top_assets", "TakeOrderedAndProject"), ("q36_top_assets_by_dex", "WindowGroupLimit")):
        QUERIES[name](spark, sf_dir).explain()
        plan = capsys.readouterr().out
        assert sign in plan and plan.count("lineitem.parquet") == 1, name


def test_first_numbers_are_the_first(spark):
    rnd = random.Random(4)
    df = spark.createDataFrame([(rnd.choice(["a", "b", None]), rnd.choice([None, 1.0, 2.0]), i) for i in range(200)], "g string, v double, i int")
    for by in ([], ["g"]):
        whole = ranking.number_rows(df, "-v", "i", by=by, levels=3)
        assert rows(ranking.number_rows(df, "-v", "i", by=by, top=4)) == rows(whole.where("rank <= 4"))



def test_numbering_reads_its_input_twice(spark, sf_dir, capsys):
    df = QUERIES["w13_number_rows"](spark, sf_dir)
    df.collect()
    df.explain()
    final = capsys.readouterr().out.split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final or final.count("FileScan") <= 2


def test_planned_scans_of_distributions(spark, sf_dir, capsys):
    def scans(name):
        QUERIES[name](spark, sf_dir).explain()
        return capsys.readouterr().out.count("FileScan")

    base = scans("q46_value_lp_positions")
    assert scans("q49_league_table_pool") == base
    assert scans("q50_lp_ecdf_pool") <= 2 * base and scans("q50_lp_histogram_pool") <= 2 * base
    assert scans("q50_lp_density_pool") <= 4 * base


def test_small_column_has_a_bound(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    assert reshape.small_column(df, "c", 2) == ["a", "b"]
    with pytest.raises(ValueError):
        reshape.small_column(df, "c", 1)


def test_wide_ranks_pull_their_columns(spark):
    df = spark.createDataFrame([("x", "A", 1, 9), ("y", "B", 1, 3)], "swap_program string, asset_name string, rank int, swaps int")
    assert popularity.top_assets_by_dex(df, wide=True).columns == ["rank", "x", "y"]


def test_a_missing_wallet_is_one_wallet(spark):
    from tidewell.plans import upstream

    transfers = spark.createDataFrame([("1", "a", None, 6.0)], "tx_id string, from_address string, to_address string, amount double")
    actions = spark.createDataFrame([(None, "p", "deposit", 3.0)], "address string, pool_name string, action string, stake_units double")
    assert rows(upstream.ledger_balances(transfers, actions), "rune_total_balance") == [("a", -6.0, 0.0, -6.0), (None, 6.0, 3.0, 9.0)]
