"""Plans of the registered queries: no cross joins, no Python in the data path, only needed columns."""

import pytest

from tidewell.catalog import QUERIES

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "FlatMapGroups")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, sf_dir, capsys, name):
    QUERIES[name](spark, sf_dir).explain("formatted")
    plan = capsys.readouterr().out
    assert not [x for x in FORBIDDEN if x in plan]


def test_scans_read_only_what_is_used(spark, sf_dir, capsys):
    QUERIES["q24_weekly_new_users"](spark, sf_dir).explain("formatted")
    plan = capsys.readouterr().out
    scans = [line for line in plan.splitlines() if line.startswith("ReadSchema:")]
    assert scans and all("props" not in line and "value" not in line for line in scans)


def test_price_filters_reach_the_scan(spark, sf_dir, capsys):
    QUERIES["s02_price_source"](spark, sf_dir).explain("formatted")
    plan = capsys.readouterr().out
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters:"))
    assert all(x in pushed for x in ("In(o_orderpriority", "EqualTo(o_orderstatus", "GreaterThanOrEqual(o_orderdate", "LessThan(o_orderdate"))


def test_building_a_query_runs_no_job(spark, sf_dir):
    tracker = spark.sparkContext.statusTracker()
    for name in ("w13_number_rows", "q35_top_assets", "q49_league_table_pool", "q50_lp_density_pool", "q57_focus_groups", "u2_asset_popularity", "q41_tvl_metrics"):
        before = set(tracker.getJobIdsForGroup())
        QUERIES[name](spark, sf_dir)
        assert set(tracker.getJobIdsForGroup()) == before, name


def test_pairs_are_made_after_counting_paths(spark, sf_dir, capsys):
    QUERIES["q28_directed_crossover"](spark, sf_dir).explain("formatted")
    plan = capsys.readouterr().out
    # The two joins add the node ids; wallets are never joined with themselves.
    assert plan.count("Join Inner") == 0 and "SortMergeJoin" not in plan
