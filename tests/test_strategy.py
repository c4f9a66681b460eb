import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewell.plans import strategy as s


def week(before, *closes):
    """A quote on the Thursday before, then one per day from Friday."""
    return [before, *closes]


def closing(df):
    return df.orderBy(F.desc("timestamp")).first()


@pytest.mark.parametrize("close, want, excess", [(120.0, 0.1592, -0.0408), (80.0, -0.1908, 0.0092), (110.0, 0.1092, 0.0092)])
def test_payoff_of_one_week(prices, close, want, excess):
    df = prices("2022-01-06", luna=week(100.0, close))
    got = closing(s.covered_call_portfolio(df, 1.15, 0.0092))
    assert got["covered_call_returns"] == pytest.approx(want)
    assert got["covered_call_returns"] - (close / 100 - 1) == pytest.approx(excess)


def test_payoff_of_two_weeks(prices):
    def run(first, second):
        df = prices("2022-01-06", luna=[100.0] + [first] * 7 + [second] * 7)
        weekly = s.covered_call_portfolio(df, 1.15, 0.0092).groupBy("week").agg(
            F.max_by("covered_call_returns", "timestamp").alias("r")
        )
        return [x["r"] for x in weekly.orderBy("week").collect()][1:]

    flat = run(110.0, 100.0)
    assert sum(flat) - (0.10 - 1 / 11) == pytest.approx(0.0184)
    swing = run(120.0, 100.0)
    assert sum(swing) - (0.20 - 1 / 6) == pytest.approx(-0.0316)


def test_hold_starts_at_100_and_calls_never_win_without_premium(prices):
    df = prices(luna=[50.0, 55.0, 70.0, 60.0, 52.0, 51.0, 58.0, 90.0, 91.0])
    got = rows(s.covered_call_portfolio(df), "timestamp")
    names = ["coin_id", "timestamp", "week", "returns", "covered", "hold"]
    first_week = [dict(zip(names, x)) for x in got if x[2] == dt.date(2022, 1, 7)]
    assert first_week[0]["hold"] == 100
    assert all(x["covered"] <= x["hold"] + 1e-9 for x in first_week)


def test_a_missing_price(prices):
    df = prices("2022-01-06", luna=[100.0, 110.0, None, 120.0])
    got = {x[1].day: x[3] for x in rows(s.covered_call_portfolio(df), "timestamp")}
    assert got[7] == pytest.approx(0.10) and got[8] is None
    # The day after a missing price falls back on its own price, but the week opened before.
    assert got[9] == pytest.approx(0.15)


def test_strikes_round_half_to_even(prices):
    # 1.25 * 2 = 2.5 -> 2 -> 1.0;  1.75 * 2 = 3.5 -> 4 -> 2.0
    got = rows(s.strikes(prices(a=[1.25], b=[1.75]), mult=1.0))
    assert [x[-2] for x in got] == [1.0, 2.0]


def test_strikes_use_the_price_before_the_week_and_cut_last(prices):
    df = prices("2022-01-06", luna=[100.0, 50.0, 60.0])
    got = rows(s.weekly_strikes(df, 1.1, since="2022-01-07"), "timestamp", "type")
    assert [(x[1].day, x[-2], x[-1]) for x in got] == [
        (7, "price", 50.0), (7, "simulated_strike", 110.0), (8, "price", 60.0), (8, "simulated_strike", 110.0),
    ]


def test_breaches_and_level_days(prices):
    df = prices("2022-01-06", luna=[100.0] + [130.0] * 7 + [131.0] * 7)
    assert rows(s.strike_breaches(df, 1.15)) == [("luna", 3, 1)]
    assert rows(s.level_days(df, 130.5)) == [("luna", 15, 7, 8)]
    assert rows(s.level_days(df, 130.5, "2022-01-14")) == [("luna", 7, 7, 0)]
    assert rows(s.level_days(prices(a=[1.0, None]), 0.5)) == [("a", 2, None, None)]
    assert s.price_window(df, "2022-01-14").count() == 7


def test_summary(prices):
    df = prices("2022-01-07", luna=[100.0] * 7 + [130.0] * 7 + [120.0] * 7)
    got = s.portfolio_summary(s.covered_call_portfolio(df)).first()
    covered = 1.15 * 120 / 130
    assert (got["weeks"], got["weeks_behind"]) == (3, 1)
    assert got["hold_return"] == pytest.approx(0.2)
    assert got["covered_call_return"] == pytest.approx(covered - 1)
    assert got["average_shortfall"] == pytest.approx(-0.15)
    assert got["breakeven_yield"] == pytest.approx((1.2 / covered) ** (1 / 3) - 1)


def test_summary_without_a_bad_week(prices):
    got = s.portfolio_summary(s.covered_call_portfolio(prices(luna=[100.0, 101.0]))).first()
    assert got["weeks_behind"] == 0 and got["average_shortfall"] is None


def test_premiums_rolling_return_and_segments(prices):
    df = prices(luna=[100.0 + i for i in range(10)])
    got = s.premium_sensitivity(df, [0.0, 0.01])
    assert {x[0] for x in got.select("portfolio").distinct().collect()} == {
        "hold", "covered_call_0.00pct", "covered_call_1.00pct",
    }
    single = {x[1]: x[4] for x in rows(s.covered_call_portfolio(df, premium=0.01))}
    assert {x[1]: x[3] for x in rows(got.where("portfolio = 'covered_call_1.00pct'"))} == pytest.approx(single)
    rolled = rows(s.rolling_return(df, 6, "2022-01-12"), "timestamp")
    assert rolled[0][2] is None and rolled[1][2] == pytest.approx(0.06)
    ends = rows(s.strike_segments(s.weekly_strikes(df)), "x_end")
    assert ends[0][1] is None and ends[1][1] == ends[0][2]


def test_coins_do_not_mix(prices):
    both = prices(a=[100.0, 110.0, 90.0], b=[5.0, 6.0, 7.0])
    alone = prices(b=[5.0, 6.0, 7.0])
    got = [x for x in rows(s.covered_call_portfolio(both)) if x[0] == "b"]
    assert got == rows(s.covered_call_portfolio(alone))
