import numpy as np
import pytest

from tests.conftest import rows
from tidewell.plans import risk


def test_index_starts_at_100(prices):
    df = risk.market_cap_index(prices(a=[1.0, 2.0], b=[3.0, 4.0]))
    assert [x[3] for x in rows(df, "timestamp")] == pytest.approx([100.0, 150.0])


def test_drawdowns(prices):
    df = risk.normalize_and_drawdown(prices(a=[2.0, 4.0, 3.0, 5.0]))
    a = [x for x in rows(df, "coin_id", "timestamp") if x[0] == "a"]
    at = {c: i for i, c in enumerate(df.columns)}
    assert [x[at["price"]] for x in a] == [100.0, 200.0, 150.0, 250.0]
    assert [x[at["drawdown"]] for x in a] == [0.0, 0.0, -0.25, 0.0]
    rolled = risk.rolling_drawdown(df, 2).where("coin_id = 'a'")
    assert [x["rolling_drawdown"] for x in rolled.orderBy("timestamp").collect()] == [0.0, 0.0, -0.25, 0.0]


def test_trailing_maximum_forgets(prices):
    df = risk.normalize_and_drawdown(prices(a=[10.0] + [5.0] * 40))
    got = risk.rolling_drawdown(df).where("coin_id = 'a'").orderBy("timestamp").collect()
    assert [x["rolling_drawdown"] for x in got][29:31] == [-0.5, 0.0]


def test_month_starts_afresh(prices):
    df = risk.normalize_and_drawdown(prices("2022-01-30", a=[10.0, 8.0, 8.0, 6.0]))
    got = risk.monthly_max_drawdown(df).where("coin_id = 'a'").orderBy("timestamp").collect()
    assert [x["month_max_drawdown"] for x in got] == pytest.approx([-0.2, -0.2, -0.25, -0.25])


def test_window_and_names(prices):
    df = risk.clean_prices(prices("2022-01-01", **{"terra-luna": [1.0] * 10}), "2022-01-03", "2022-01-05")
    assert df.count() == 3 and df.first()["coin_id"] == "luna"


def test_returns_take_one_close_per_day(prices):
    df = prices(a=[1.0, 2.0, 3.0])
    twice = df.unionByName(df)
    got = rows(risk.returns_vs_benchmark(twice, risk.market_cap_index(df)), "coin_id", "timestamp")
    a = [x for x in got if x[1] == "a"]
    assert [x[2] for x in a] == pytest.approx([0.0, 1.0, 0.5])
    assert [x[3] for x in a] == pytest.approx([0.0, 1.0, 0.5])


def test_tables(prices):
    rng = np.random.default_rng(9)
    base = np.cumprod(1 + rng.normal(0, 0.03, 300))
    other = base * np.cumprod(1 + rng.normal(0, 0.02, 300))
    returns = risk.returns_vs_benchmark(prices(a=[float(x) for x in base], b=[float(x) for x in other]))
    index = risk.capm_table(returns).where("coin_id = 'index'").first()
    assert index["beta"] == pytest.approx(1) and index["correlation"] == pytest.approx(1)
    table = {x["coin_id"]: x for x in risk.downside_risk_table(returns).collect()}
    path = np.concatenate([[1.0], other / other[0]])
    assert table["b"]["maximum_drawdown"] == pytest.approx((1 - path / np.maximum.accumulate(path)).max())
    side = {x["coin_id"]: x for x in risk.side_correlations(returns).collect()}
    assert side["index"]["corr_up"] == pytest.approx(1)


def test_upper_tail(spark):
    data = [("same", float(i), float(i)) for i in range(10)] + [("opposite", float(i), float(-i)) for i in range(10)]
    data += [("same", None, 3.0)]
    df = spark.createDataFrame(data, "coin_id string, ra double, rb double")
    assert rows(risk.tail_dependence_table(df, 0.8)) == [("opposite", 0.0), ("same", pytest.approx(1.0))]
    chibar = dict(rows(risk.tail_dependence_table(df, 0.8, "chibar")))
    assert chibar["same"] == pytest.approx(1.0) and chibar["opposite"] is None
