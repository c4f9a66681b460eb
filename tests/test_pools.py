import datetime as dt

import pytest

from tests.conftest import rows
from tidewell.plans import lp, pools, tvl

D = dt.date(2022, 1, 1)


def day(n):
    return D + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def metrics(spark):
    # (day, pool, added, withdrawn, tvl, asset units, rune units, asset price, rune price)
    data = [
        (day(0), "BTC.BTC", 100.0, 0.0, 100.0, 1.0, 10.0, 50.0, 5.0),
        (day(2), "BTC.BTC", 0.0, 40.0, 80.0, 0.5, 10.0, 60.0, 6.0),
        (day(1), "ETH.USDC-0XA0B8", 10.0, 0.0, 11.0, 5.0, 1.0, 1.0, 6.0),
        (day(3), "ETH.USDC-0XA0B8", 5.0, 0.0, None, 7.0, 1.0, 1.0, 7.0),
    ]
    df = spark.createDataFrame(
        data,
        "day date, pool_name string, added_liquidity_usd double, withdrawn_liquidity_usd double, tvl double, "
        "asset_liquidity double, rune_liquidity double, asset_price_usd double, rune_price_usd double",
    )
    return tvl.tvl_metrics(df)


def test_metrics_are_dense_from_inception(metrics):
    got = {(r["pool_name"], r["day"]): r for r in metrics.collect()}
    assert {k[1] for k in got if k[0] == "BTC.BTC"} == {day(0), day(1), day(2), day(3)}
    assert {k[1] for k in got if k[0] != "BTC.BTC"} == {day(1), day(2), day(3)}
    btc = [got["BTC.BTC", day(i)] for i in range(4)]
    assert [r["dollar_value_locked"] for r in btc] == [100.0, 100.0, 60.0, 60.0]
    assert [r["dollar_value_gained"] for r in btc] == [0.0, 0.0, 20.0, 20.0]
    assert [r["normalized_tvl"] for r in btc] == [120.0, 120.0, 90.0, 90.0]  # the pool's own latest prices
    usdc = got["ETH.USDC-0XA0B8", day(3)]
    assert (usdc["dollar_value_locked"], usdc["tvl"]) == (15.0, 11.0)  # a missing value takes the last one
    assert (usdc["blockchain"], usdc["token"]) == ("ETH", "USDC")


def test_value_is_locked_plus_gained(metrics):
    for r in metrics.where("pool_name = 'BTC.BTC'").collect():
        assert r["tvl"] == r["dollar_value_locked"] + r["dollar_value_gained"]


def test_totals(spark, metrics):
    long = {(r["day"], r["variable"]): r["value"] for r in tvl.protocol_tvl(metrics).collect()}
    assert long[day(1), "tvl"] == 111.0 and long[day(0), "tvl"] == 100.0
    assert tvl.tvl_by_chain(metrics).count() == 7
    assert tvl.tvl_by_chain_token(metrics, "ETH").count() == 3
    platform = spark.createDataFrame([(day(0), 99.0)], "day date, total_value_pooled_usd double")
    both = {(r["day"], r["variable"]): r["value"] for r in tvl.reconcile_tvl(metrics, platform).collect()}
    assert both[day(0), "total_value_pooled_usd"] == 99.0 and both[day(1), "total_value_pooled_usd"] is None


@pytest.fixture(scope="module")
def swaps(spark):
    at = [dt.datetime(2022, 1, 1) + dt.timedelta(days=i) for i in range(9)]
    return spark.createDataFrame(
        [
            (at[0], "BTC/BTC", "BTC.BTC", 1.0, 10.0, 1),
            (at[0], "BTC.BTC", "BTC.BTC", 2.0, 20.0, 2),
            (at[0], "RUNE", "BTC.BTC", 3.0, 70.0, 1),
            (at[8], "RUNE", "BTC.BTC", 3.0, 70.0, 1),
            (at[5], "RUNE", "ETH.ETH", 1.0, 5.0, 1),
            (at[8], "RUNE", "ETH.ETH", 1.0, 6.0, 1),
        ],
        "date timestamp_ntz, from_asset string, pool_name string, fees_usd double, from_amount_usd double, swaps long",
    )


def test_synthetics_merge(swaps):
    got = pools.canonical_pool_swaps(swaps).where("from_asset = 'BTC.BTC'").first()
    assert (got["fees_usd"], got["from_amount_usd"], got["swaps"]) == (3.0, 30.0, 3)


def test_pools_start_together(swaps):
    found = pools.since_inception(swaps, ["BTC.BTC", "ETH.ETH"])
    assert {(r["pool_name"], r["date_reference"].day) for r in found.collect()} == {("BTC.BTC", 1), ("ETH.ETH", 6)}
    got = rows(found.select("day", "pool_name", "from_amount_usd", "swaps"))
    assert got == [(0, "BTC.BTC", 100.0, 4), (0, "ETH.ETH", 5.0, 1), (3, "ETH.ETH", 6.0, 1)]
    assert pools.since_inception(swaps, ["ETH.ETH"], 2).count() == 1


def test_summary_and_shares(swaps):
    merged = pools.canonical_pool_swaps(swaps)
    assert pools.pool_summary(merged, "2022-01-09").count() == 2
    got = {r["from_asset"]: r["share"] for r in pools.origination_share(merged, "BTC.BTC").where("date < '2022-01-02'").collect()}
    assert got == {"BTC.BTC": 0.3, "RUNE": 0.7}
    n = {r["from_asset"]: r["share"] for r in pools.origination_share(merged, "BTC.BTC", "swaps").where("date < '2022-01-02'").collect()}
    assert n == {"BTC.BTC": 0.75, "RUNE": 0.25}


@pytest.fixture(scope="module")
def positions(spark):
    data = [("w1", "BTC.BTC", 1.0), ("w2", "BTC.BTC", 3.0), ("w3", "BTC.BTC", -2.0), ("w1", "ETH.X-0X1", 5.0), ("w1", "GONE", 1.0)]
    pos = spark.createDataFrame(data, "wallet string, pool_name string, lp_position double")
    liq = spark.createDataFrame(
        [(day(0), "BTC.BTC", 1.0), (day(1), "BTC.BTC", 400.0), (day(1), "ETH.X-0X1", 50.0)],
        "day date, pool_name string, total_liquidity_usd double",
    )
    return lp.value_lp_positions(pos, liq), liq


def test_positions_share_the_latest_liquidity(positions):
    got = {(r["wallet"], r["pool_name_short"]): (r["lp_position_usd"], r["chain"]) for r in positions[0].collect()}
    assert got == {
        ("w1", "BTC.BTC"): (100.0, "BTC"), ("w2", "BTC.BTC"): (300.0, "BTC"),
        ("w1", "ETH.X"): (50.0, "ETH"), ("w1", "GONE"): (None, None),
    }


def test_league_tables(positions):
    assert rows(lp.league_table(positions[0]), "pool_name_short") == [
        ("BTC.BTC", "BTC", 2, 400.0, 1), ("ETH.X", "ETH", 1, 50.0, 2), ("GONE", None, 1, None, None),
    ]
    assert rows(lp.league_table(positions[0], "chain"), "rank") == [("BTC", 2, 400.0, 1), ("ETH", 1, 50.0, 2), (None, 1, 0.0, 3)]


def test_top_and_other_pools_with_a_tie(spark):
    sizes = [100, 90, 80, 70, 60, 50, 40, 30, 20, 10, 10, 5]
    df = spark.createDataFrame([("w", f"C.P{i:02d}", float(v)) for i, v in enumerate(sizes)] + [("w", "C.Z", 100.0)],
                               "wallet string, pool_name_short string, lp_position_usd double")
    top, others = lp.split_top_pools(df)
    assert [r[0] for r in rows(top)] == [f"C.P{i:02d}" for i in range(9)] + ["C.Z"]
    assert [r[0] for r in rows(others)] == ["C.P09", "C.P10", "C.P11"]
    assert {r[0] for r in rows(lp.default_pools(df, 1))} == {"C.P00", "C.Z"}


def test_selected_distributions(positions):
    valued, liq = positions
    assert {r[0] for r in rows(lp.default_chains(liq, 1))} == {"BTC"}
    pooled = lp.lp_distribution(valued, ["BTC.BTC"], "ecdf")
    assert rows(pooled) == [(100.0, 0.5), (300.0, 1.0)]
    chosen = lp.lp_distribution(valued, lp.default_pools(valued), "ecdf", "pool")
    assert {r[0] for r in rows(chosen)} == {"BTC.BTC"}
    assert {r[0] for r in rows(lp.lp_distribution(valued, None, "histogram", "chain"))} == {"BTC", "ETH"}
    assert lp.tvl_distribution(liq, "histogram").count() == 10
    assert lp.tvl_distribution(liq, "histogram", "chain").count() == 5
    with pytest.raises(ValueError):
        lp.lp_distribution(valued, None, "pie")
