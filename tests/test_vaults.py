import datetime as dt
import random
from itertools import permutations

import pytest

from tests.conftest import rows
from tidewell.plans import crossover as x
from tidewell.plans import flows as f

SCHEMA = "block_timestamp timestamp_ntz, type string, vault string, amount double, address string"


@pytest.fixture(scope="module")
def events(spark):
    def build(*data):
        day0 = dt.datetime(2022, 1, 7)
        return spark.createDataFrame(
            [(day0 + dt.timedelta(days=t), kind, vault, float(n), who) for t, kind, vault, n, who in data], SCHEMA
        )

    return build


@pytest.fixture(scope="module")
def rates(spark):
    def build(*data):
        day0 = dt.date(2022, 1, 7)
        return spark.createDataFrame(
            [("c" + token, day0 + dt.timedelta(days=t), price, token) for t, token, price in data],
            "coin_id string, date date, price double, token string",
        )

    return build


def test_midnight_quotes_belong_to_the_day_before(spark):
    quotes = spark.createDataFrame(
        [("sol", dt.datetime(2022, 1, 8), 1.0), ("sol", dt.datetime(2022, 1, 9, 15), 2.0), ("x", dt.datetime(2022, 1, 8), 3.0)],
        "coin_id string, timestamp timestamp_ntz, price double",
    )
    tokens = spark.createDataFrame([("sol", "SOL")], "coin_id string, token string")
    got = f.attribute_price_day(quotes, tokens, "2022-01-09").select("coin_id", "date", "token")
    assert rows(got) == [("sol", dt.date(2022, 1, 7), "SOL"), ("sol", dt.date(2022, 1, 9), "SOL"), ("x", dt.date(2022, 1, 7), None)]


def test_prices_are_filled_on_event_days_only(events, rates):
    ev = events((0, "deposit", "A", 1, "u"), (3, "deposit", "A", 2, "u"), (3, "withdrawal", "A", 1, "u"))
    quotes = rates((0, "A", 10.0), (2, "A", 20.0))
    faithful = {(r[0].day, r[1]): r[5] for r in rows(f.daily_valued_flows(ev, quotes))}
    assert faithful == {(7, "deposit"): 10.0, (10, "deposit"): 20.0, (10, "withdrawal"): None}
    asof = {(r[0].day, r[1]): r[5] for r in rows(f.daily_valued_flows(ev, quotes, "asof"))}
    assert asof == {(7, "deposit"): 10.0, (10, "deposit"): 40.0, (10, "withdrawal"): 20.0}
    with pytest.raises(ValueError):
        f.daily_valued_flows(ev, quotes, "nearest")


def test_weekly_totals_and_benchmark(events, rates):
    ev = events((0, "deposit", "A", 5, "u"), (7, "withdrawal", "A", 2, "u"), (14, "deposit", "A", 1, "u"))
    weekly = f.weekly_net_flows(f.daily_valued_flows(ev, rates((0, "A", 1.0), (7, "A", 1.0), (14, "A", 1.0))))
    assert [(r[2], r[4]) for r in rows(weekly, "week")] == [(5.0, 5.0), (-2.0, 3.0), (1.0, 4.0)]
    marks = f.cumulative_vs_benchmark(weekly, "2022-01-14").where("type = 'benchmark'")
    assert [r[3] for r in rows(marks, "week")] == [None, 3.0, 3.0]
    assert f.net_flows_since(weekly, "2022-01-14").count() == 2


def test_missing_price_spoils_the_running_total(events, rates):
    ev = events((0, "deposit", "A", 5, "u"), (7, "deposit", "A", 2, "u"))
    weekly = f.weekly_net_flows(f.daily_valued_flows(ev, rates((7, "A", 1.0))))
    assert [(r[3], r[5]) for r in rows(weekly, "week")] == [(None, None), (2.0, None)]


def test_weeks_of_known_users_stay_with_zero(events):
    ev = events(
        (0, "deposit", "A", 1, "u"), (1, "deposit", "A", 1, "v"), (8, "deposit", "A", 1, "u"),
        (15, "deposit", "A", 1, "w"), (9, "withdrawal", "A", 1, "z"), (16, "deposit", "A", 1, None),
    )
    users = f.weekly_new_users(ev)
    assert [(r[2], r[3]) for r in rows(users, "week")] == [(2, 2), (2, 0), (4, 2)]
    assert [r[2] for r in rows(f.weekly_new_users(ev, na_include=False), "week")] == [2, 2, 3]
    assert [r[3] for r in rows(f.new_users_since(users, "2022-01-14"), "week")] == [0, 2]


def test_vaults_per_wallet(events):
    ev = events((0, "deposit", "A", 1, "u"), (0, "withdrawal", "B", 1, "u"), (0, "deposit", "A", 1, "v"))
    assert rows(f.vaults_per_wallet(ev)) == [(1, 1, 0.5), (2, 1, 0.5)]


def test_simultaneous_first_deposits(events):
    ev = events(
        (0, "deposit", "A", 1, "u"), (0, "deposit", "B", 1, "u"), (0, "deposit", "B", 1, "u"), (5, "deposit", "C", 1, "u"),
        (1, "deposit", "B", 1, "v"), (2, "deposit", "A", 1, "v"), (9, "withdrawal", "C", 1, "v"),
    )
    nodes = x.crossover_nodes(ev)
    assert rows(nodes, "id") == [(1, "A", 2, 1), (2, "B", 2, 3), (3, "C", 1, 0)]
    edges = x.directed_crossover(ev, nodes)
    assert [(r[4], r[5], r[2], r[3]) for r in rows(edges)] == [("A", "C", 1, 0.5), ("B", "A", 1, 0.5), ("B", "C", 1, 0.5)]
    by_first = {(r[4], r[5]): r[3] for r in rows(x.directed_crossover(ev, nodes, "first_depositors"))}
    assert by_first == {("A", "C"): 1.0, ("B", "A"): pytest.approx(1 / 3), ("B", "C"): pytest.approx(1 / 3)}
    with pytest.raises(ValueError):
        x.directed_crossover(ev, nodes, "vault")


def test_crossover_against_all_pairs(events):
    random.seed(11)
    data = [(random.randint(0, 6), "deposit", random.choice("ABCD"), 1, f"u{random.randint(0, 30)}") for _ in range(200)]
    # One wallet holds a third of all rows.
    data += [(random.randint(0, 6), "deposit", random.choice("ABCD"), 1, "whale") for _ in range(100)]
    first = {}
    for t, _, vault, _, who in data:
        first[who, vault] = min(t, first.get((who, vault), t))
    want = {}
    for who in {w for w, _ in first}:
        for a, b in permutations("ABCD", 2):
            if (who, a) in first and (who, b) in first and first[who, a] < first[who, b]:
                want[a, b] = want.get((a, b), 0) + 1
    ev = events(*data)
    edges = x.directed_crossover(ev, x.crossover_nodes(ev))
    assert {(r[4], r[5]): r[2] for r in rows(edges)} == want
    assert sum(r[4] for r in rows(x.undirected_crossover(edges))) == sum(want.values())


def test_graph_export(events):
    ev = events((0, "deposit", "B", 1, "u"), (1, "deposit", "A", 1, "u"))
    nodes = x.crossover_nodes(ev)
    shown, links = x.graph_export(nodes, x.directed_crossover(ev, nodes))
    assert rows(shown, "id")[0] == (1, 0, "A", 0.0, "A vault, Depositors: 1")
    assert rows(links) == [(2, 1, 1, 0, 1 / 30, 100.0, "B to A: 1")]
