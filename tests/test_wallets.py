import datetime as dt

import pytest

from tests.conftest import rows
from tidewell.plans import focus, popularity, upstream, wallets, whales

DAY = dt.datetime(2022, 1, 5)


@pytest.fixture(scope="module")
def swaps(spark):
    data = [
        (DAY, "a", "x", "1", "ALGO", "2", "USDC", 5.0),
        (DAY, "a", "x", "1", "ALGO", "2", "USDC", 1.0),
        (DAY, "b", "y", "2", "USDC", "3", "GARD", 1.0),
        (DAY + dt.timedelta(days=9), "b", "y", "1", "ALGO", "2", "USDC", 0.0),
        (DAY - dt.timedelta(days=30), "c", "y", None, None, "2", "USDC", 2.0),
    ]
    return spark.createDataFrame(
        data,
        "block_timestamp timestamp_ntz, swapper string, swap_program string, swap_from_asset_id string, "
        "swap_from_name string, swap_to_asset_id string, swap_to_name string, swap_from_amount double",
    )


def test_wallet_statistics(swaps):
    assert rows(upstream.wallet_swap_stats(swaps, "2022-01-01")) == [("a", 2, 1), ("b", 1, 1)]
    assert upstream.wallet_swap_stats(swaps).count() == 3


def test_popularity(swaps):
    ranked = upstream.asset_popularity(swaps)
    assert rows(ranked, "rank") == [("2", "USDC", 3, 1), ("3", "GARD", 1, 2)]
    assert [r["asset_name"] for r in popularity.top_assets(ranked, 1).collect()] == ["USDC"]
    by_dex = upstream.asset_popularity(swaps, by_dex=True)
    wide = popularity.top_assets_by_dex(by_dex, wide=True, dexes=["x", "y"])
    assert wide.columns == ["rank", "x", "y"]
    assert rows(wide, "rank") == [(1, "USDC", "USDC"), (2, None, "GARD")]
    assert popularity.top_assets_by_dex(by_dex, 1).count() == 2


def test_whales(spark):
    accounts = spark.createDataFrame(
        [("a", 200000.0, "sig", False), ("b", 199999.0, "sig", False), ("c", 9e9, "lsig", False), ("d", 9e9, "sig", True),
         ("e", 9e9, "sig", False)],
        "address string, balance double, wallet_type string, account_closed boolean",
    )
    labels = spark.createDataFrame([("e",)], "address string")
    assert [r[0] for r in rows(upstream.identify_whales(accounts, labels))] == ["a"]


def test_whale_tables(spark, swaps):
    found = spark.createDataFrame([("a", 10.0), ("b", 20.0), ("z", 60.0)], "address string, balance double")
    assert whales.balance_summary(found).select(
        "count", "max_balance", "avg_balance", "median_balance", "min_balance"
    ).first()[:] == (3, 60.0, 30.0, 20.0, 10.0)
    assert [r[0] for r in whales.wallet_listing(found).collect()] == ["z", "b", "a"]
    assert rows(whales.participation(found, swaps)) == [("no", 1, pytest.approx(1 / 3)), ("yes", 2, pytest.approx(2 / 3))]
    assert sum(r["count"] for r in whales.swaps_per_whale(swaps).collect()) == 3
    assert upstream.whale_swaps(swaps, found, "2022-01-01").count() == 4


def test_asset_flows(swaps):
    left = whales.asset_flow_summary(swaps)
    # GARD is only swapped to; ALGO only from; a missing name is an asset of its own.
    assert rows(left, "asa") == [("ALGO", None, 3, None, None), ("USDC", 4, 1, 4, 5), (None, None, 1, None, None)]
    assert left.first()["asa"] == "USDC"
    assert {r["asa"] for r in whales.asset_flow_summary(swaps, "full").collect()} == {"ALGO", "USDC", "GARD", None}


def test_dense_weeks(swaps):
    got = {(r[0], r[1]): (r[2], r[3]) for r in rows(whales.weekly_dense_counts(swaps, "from"))}
    assert len(got) == 9
    assert got[dt.date(2022, 1, 9), "ALGO"] == (1, 2.0)
    assert got[dt.date(2022, 1, 16), "USDC"] == (None, 0.0)
    assert got[dt.date(2021, 12, 12), None] == (1, 1.0)


def test_holdings(spark):
    df = spark.createDataFrame([("a", -5.0), ("b", 7.0), ("c", None), ("d", 0.0)], "address string, rune_total_balance double")
    assert [tuple(r) for r in wallets.clamp_and_rank_holdings(df).collect()] == [("b", 7.0), ("a", 0.0), ("d", 0.0), ("c", None)]
    assert wallets.log_histogram(df, "rune_total_balance").count() == 1
    assert rows(wallets.inverse_cdf(df, "rune_total_balance")) == [(pytest.approx(1 / 3), -5.0), (pytest.approx(2 / 3), 0.0), (1.0, 7.0)]
    assert rows(wallets.quantile_table(df, "rune_total_balance", [0.5, 0.99])) == [(0.5, 0.0), (0.99, 7.0)]


def test_focus(swaps):
    with pytest.warns(UserWarning):
        focus.focus_groups(swaps, "swap_to_name", ["USDC"], ["red"]).collect()
    got = dict(rows(focus.focus_groups(swaps, "swap_to_name", ["USDC", "FOO"], ["red", "blue", "grey"])))
    assert got == {"USDC": "red", "FOO": "blue", "GARD": "grey"}
    assert rows(focus.unmatched_values(swaps, "swap_to_name", ["USDC", "FOO"])) == [("FOO",)]
    assert rows(focus.ambiguous_ids(swaps, "swapper", "swap_to_name")) == [("b", 2)]


def test_ledger(spark):
    transfers = spark.createDataFrame(
        [("1", "a", "b", 5.0), ("2", "b", "c", 1.5), ("3", "a", "a", 9.0)],
        "tx_id string, from_address string, to_address string, amount double",
    )
    actions = spark.createDataFrame(
        [("b", "P", "deposit", 3.0), ("b", "P", "withdraw", 1.0), ("z", "Q", "withdraw", 2.0)],
        "address string, pool_name string, action string, stake_units double",
    )
    assert rows(upstream.ledger_balances(transfers, actions)) == [
        ("a", -5.0, 0.0, -5.0), ("b", 3.5, 2.0, 5.5), ("c", 1.5, 0.0, 1.5), ("z", 0.0, -2.0, -2.0),
    ]
    assert rows(upstream.net_lp_positions(actions)) == [("b", "P", 2.0), ("z", "Q", -2.0)]


def test_vault_events_out_of_transactions(spark):
    def tx(first_account, seventh, *inner, program="prog"):
        accounts = [first_account, "2", "3", "4", "5", "6", seventh]
        return (DAY, program, accounts, [{"type": t, "amount": n} for t, n in inner], "me")

    raw = spark.createDataFrame(
        [
            tx("va", "mint", ("transfer", 1.0)),
            tx("va", "mint", ("burn", None), ("transfer", 2.0)),
            tx("va", "mint", ("burnr", None), ("transfer", 3.0)),
            tx("va", "other", ("transfer", 4.0)),
            tx("va", "mint", ("burn", 5.0)),
            tx("va", "mint", ("close", 6.0), ("transfer", 6.0)),
            tx("elsewhere", "mint", ("transfer", 7.0)),
            tx("va", "mint", ("transfer", 8.0), program="another"),
            (DAY, "prog", ["va"], [], "me"),
        ],
        "block_timestamp timestamp_ntz, program_id string, accounts array<string>, "
        "inner_instructions array<struct<type:string,amount:double>>, signer string",
    )
    vaults = spark.createDataFrame([("va", "mint", "SOL")], "address string, token string, vault string")
    got = upstream.extract_vault_events(raw, vaults, "prog").select("type", "vault", "amount", "address")
    assert rows(got, "amount") == [
        ("deposit", "SOL", 1.0, "me"), ("withdrawal", "SOL", 2.0, "me"), ("withdrawal", "SOL", 3.0, "me"),
    ]
