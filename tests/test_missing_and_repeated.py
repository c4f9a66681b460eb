"""Missing keys, repeated rows and other inputs that the benchmark tables do not hold."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewell.operators import distribution
from tidewell.operators import reshape as r
from tidewell.operators.ranking import number_rows
from tidewell.plans import crossover, focus, pools, risk, strategy, upstream

DAY = dt.date(2022, 1, 1)


def day(i):
    return None if i is None else DAY + dt.timedelta(days=i)


def test_one_bin_spans_all_values(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    assert rows(distribution.histogram(df, "v", 1, log10=False)) == [(0, 1.0, 10.0, 10, 1.0)]
    one = distribution.histogram(df.where("v = 3"), "v", 1, log10=False).collect()
    assert [x["count"] for x in one] == [1]


def test_carry_to_next_keeps_every_row(spark):
    given = [("a", day(0), 1), ("a", day(0), 2), ("b", day(1), 3), ("b", None, 4), (None, day(2), 5)]
    got = r.carry_to_next(spark.createDataFrame(given, "k string, day date, n int"), "k", "day").collect()
    by_key = {}
    for x in got:
        by_key.setdefault(x.k, []).append((x.day, x.n))
    assert sorted(d for d, _ in by_key["a"]) == [day(0), day(0), day(1), day(2)]
    assert {n for d, n in by_key["a"] if d == day(0)} == {1, 2}
    assert set(by_key["b"]) == {(day(1), 3), (day(2), 3), (None, 4)} and len(by_key["b"]) == 3
    assert by_key[None] == [(day(2), 5)]


def test_complete_grid_with_missing_and_repeated_pairs(spark):
    given = [("a", day(0), 1), ("a", day(0), 2), ("b", None, 3)]
    got = r.complete_grid(spark.createDataFrame(given, "k string, day date, n int"), "day", "k", ["n"])
    assert rows(got) == sorted([(day(0), "a", 1), (day(0), "a", 2), (day(0), "b", None), (None, "a", None), (None, "b", 3)], key=lambda x: [(v is None, v) for v in x])


def test_pools_without_a_name_have_an_inception_too(spark):
    daily = spark.createDataFrame([(None, DAY, 1.0, 2.0, 3), ("p", DAY, 1.0, 2.0, 3)], "pool_name string, date date, fees_usd double, from_amount_usd double, swaps long")
    assert rows(pools.since_inception(daily).select("pool_name", "day", "swaps")) == [("p", 0, 3), (None, 0, 3)]


def test_a_missing_value_counts_as_one(spark):
    df = spark.createDataFrame([("w", None), ("w", None), ("x", "a"), ("x", None), ("y", "b")], "k string, v string")
    assert rows(r.count_distribution(df, "k", "v", "values")) == [(1, 2), (2, 1)]
    assert rows(focus.ambiguous_ids(df, "k", "v")) == [("x", 2)]


def test_a_vault_without_a_name_keeps_its_id(spark):
    at = [dt.datetime(2022, 1, i) for i in (1, 2, 3)]
    events = spark.createDataFrame(
        [("deposit", None, "w", at[0]), ("deposit", "b", "w", at[1]), ("deposit", "b", "x", at[2])],
        "type string, vault string, address string, block_timestamp timestamp_ntz",
    )
    nodes = crossover.crossover_nodes(events)
    edge = crossover.directed_crossover(events, nodes).first()
    ids = {n.vault: n.id for n in nodes.collect()}
    assert (edge["from"], edge["to"], edge.percentage_weight) == (ids[None], ids["b"], 1.0)


def test_only_deposits_and_withdrawals_move_stake(spark):
    actions = spark.createDataFrame(
        [("w", "p", "deposit", 5.0), ("w", "p", "withdraw", 2.0), ("w", "p", "donate", 100.0), ("w", "p", None, 10.0)],
        "address string, pool_name string, action string, stake_units double",
    )
    assert rows(upstream.net_lp_positions(actions)) == [("w", "p", 3.0)]


def test_the_last_quote_of_a_day_is_its_close(spark):
    given = [("c", dt.datetime(2022, 1, 1, h), "usd", float(h), None, 1.0) for h in (18, 6, 12)]
    prices = spark.createDataFrame(given, "coin_id string, timestamp timestamp_ntz, vs_currency string, price double, total_volume double, market_cap double")
    for df in (prices, prices.repartition(7)):
        assert rows(risk.clean_prices(df).select("timestamp", "price")) == [(dt.datetime(2022, 1, 1), 18.0)]


def test_every_premium_has_its_own_label(prices):
    df = prices(c=[50.0 + i for i in range(9)])
    got = strategy.premium_sensitivity(df, [0.00501, 0.00502, 0.02, 0.02])
    names = [x.portfolio for x in got.where(F.col("timestamp") == dt.datetime(2022, 1, 7)).collect()]
    assert sorted(names) == ["covered_call_0.501pct", "covered_call_0.502pct", "covered_call_2.00pct", "hold"]


def test_labels_by_id(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None)], "id int, v string")
    groups = spark.createDataFrame([("a", "red"), (None, "grey")], "value string, label string")
    assert rows(focus.mapping_by_id(df, "id", "v", groups)) == [(1, "a", "red"), (2, "b", None), (3, None, "grey")]


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("kind", ["number", "text", "day"])
def test_numbers_like_a_sort(spark, by, kind):
    rnd = random.Random(kind)
    value = {"number": lambda: rnd.choice([7.0, 7.0, rnd.random(), None]), "text": lambda: rnd.choice(["same start x", "same start y", "é", "", None]), "day": lambda: rnd.choice([day(0), day(rnd.randint(0, 9)), None])}[kind]
    given = [(rnd.choice("ab"), value(), i) for i in range(400)]
    df = spark.createDataFrame(given, f"g string, v {dict(number='double', text='string', day='date')[kind]}, i int")
    for order, reverse in (("v", False), ("-v", True)):
        got = number_rows(df, order, "i", by=by, levels=3).collect()
        # missing values come first going up and last going down
        key = lambda x: (x[0] if by else "",)
        for group in {key(x) for x in given}:
            mine = sorted((x for x in given if key(x) == group), key=lambda x: x[2])
            known = sorted((x for x in mine if x[1] is not None), key=lambda x: x[1].encode() if kind == "text" else x[1], reverse=reverse)
            none = [x for x in mine if x[1] is None]
            want = {x[2]: n + 1 for n, x in enumerate(known + none if reverse else none + known)}
            assert {x.i: x.rank for x in got if key((x.g,)) == group} == want
