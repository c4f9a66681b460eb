import datetime as dt
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewell.operators import distribution as d
from tidewell.operators import reshape as r
from tidewell.operators import stats
from tidewell.operators.ranking import number_rows


def frame(spark, values, groups=None):
    data = list(zip(groups, values)) if groups else [("g", v) for v in values]
    return spark.createDataFrame(data, "g string, x double")


# reshape --------------------------------------------------------------------------------------


def test_long_form_keeps_missing_values(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "id int, a double, b double")
    assert rows(r.to_long(df, ["id"], ["a", "b"], "k", "v")) == [(1, "a", 2.0), (1, "b", None)]


def test_rank_matrix(spark):
    df = spark.createDataFrame([(1, "x", "A"), (2, "x", "B"), (1, "y", "C")], "rank int, dex string, name string")
    assert rows(r.rank_matrix(df, "rank", "dex", "name", ["x", "y"])) == [(1, "A", "C"), (2, "B", None)]


def test_join_matches_missing_keys(spark):
    a = spark.createDataFrame([(None, 1), ("k", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 10)], "k string, b int")
    assert rows(r.left_join_null_safe(a, b, ["k"])) == [("k", 2, None), (None, 1, 10)]


def test_complete_grid(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, None, 7)], "w int, k string, n int")
    got = rows(r.complete_grid(df, "w", "k", ["n"]))
    assert len(got) == 9
    assert [x for x in got if x[2] is not None] == [(1, "a", 5), (2, "b", 6), (3, None, 7)]


def test_forward_fill(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 3, None), ("b", 3, None)], "k string, t int, v double")
    assert rows(r.ffill(df, ["k"], ["t"], ["v"])) == [("a", 1, None), ("a", 2, 5.0), ("a", 3, 5.0), ("b", 3, None)]


def test_carrying_forward_equals_grid_and_fill(spark):
    random.seed(3)
    day = dt.date(2022, 1, 1)
    data = [(day + dt.timedelta(days=t), k, float(random.randint(0, 9))) for k in "abc" for t in range(20) if random.random() < 0.4]
    df = spark.createDataFrame(data, "day date, k string, v double")
    days = sorted({x[0] for x in data})
    want, known = [], {}
    for t in days:
        for k in "abc":
            known.update({k: v for dd, kk, v in data if (dd, kk) == (t, k)})
            if k in known:
                want.append((t, k, known[k]))
    assert rows(r.carry_to_next(df, "k", "day")) == sorted(want)


def test_shares(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("c", None), (None, 4.0)], "k string, v double")
    by = {(k, v): s for k, v, s in rows(r.share_of(df, "v", ["k"]))}
    assert by == {("a", 1.0): 0.25, ("a", 3.0): 0.75, ("b", 2.0): 1.0, ("c", None): None, (None, 4.0): 1.0}
    assert sum(x[2] for x in rows(r.share_of(df.na.drop(), "v"))) == 1.0


def test_top_keeps_ties_and_limit_does_not(spark):
    df = spark.createDataFrame([(f"p{i}", float(v)) for i, v in enumerate([9, 7, 7, 5])], "p string, v double")
    assert [x[1] for x in rows(r.top_with_ties(df, "v", 2), "p")] == [9.0, 7.0, 7.0]


def test_numbers_over_a_table(spark):
    random.seed(5)
    data = [(random.randint(0, 20), i) for i in range(500)]
    df = spark.createDataFrame(data, "v int, i int").repartition(7)
    got = number_rows(df, "-v", "i")
    want = sorted(data, key=lambda t: (-t[0], t[1]))
    assert [(x["v"], x["i"]) for x in sorted(got.collect(), key=lambda x: x["rank"])] == want
    assert sorted(x["rank"] for x in got.collect()) == list(range(1, 501))


def test_numbers_within_groups(spark):
    random.seed(6)
    data = [(random.choice(["a", "b", None]), random.randint(0, 5), i) for i in range(300)]
    df = spark.createDataFrame(data, "k string, v int, i int").repartition(5)
    got = number_rows(df, "-v", "i", by=["k"]).collect()
    for k in ("a", "b", None):
        want = sorted(((v, i) for kk, v, i in data if kk == k), key=lambda t: (-t[0], t[1]))
        assert [(x["v"], x["i"]) for x in sorted((x for x in got if x["k"] == k), key=lambda x: x["rank"])] == want
        assert sorted(x["rank"] for x in got if x["k"] == k) == list(range(1, len(want) + 1))


# distributions --------------------------------------------------------------------------------

VALUES = st.lists(st.integers(-40, 40).map(lambda i: i / 4), min_size=1, max_size=60)
FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@FEW
@given(VALUES)
def test_ecdf_against_counting(spark, values):
    got = dict(rows(d.ecdf(frame(spark, values), "x")))
    assert got == {v: sum(w <= v for w in values) / len(values) for v in values}


@FEW
@given(VALUES)
def test_quantiles_against_numpy(spark, values):
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = dict(rows(d.quantiles(frame(spark, values), "x", probs)))
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(values, p), abs=1e-12)
    disc = dict(rows(d.quantiles(frame(spark, values), "x", probs, interpolate=False)))
    for p in probs:
        assert disc[p] == min(v for v in values if sum(w <= v for w in values) / len(values) >= p)


def test_running_counts_with_a_value_held_by_a_third_of_the_rows(spark):
    random.seed(1)
    values = [7.0] * 3000 + [random.random() * 1000 for _ in range(6000)]
    df = frame(spark, values, ["a", "b", "c"] * 3000)
    got = d.ecdf(df, "x", ["g"])
    per = {g: sorted(v for h, v in zip(["a", "b", "c"] * 3000, values) if h == g) for g in "abc"}
    for g, v, e in rows(got):
        assert e == np.searchsorted(per[g], v, side="right") / len(per[g])
    assert got.count() == sum(len(set(v)) for v in per.values())


def test_missing_values_have_no_rank(spark):
    df = frame(spark, [1.0, None, 2.0, 2.0])
    assert rows(d.inverse_cdf(df, "x")) == [(1 / 3, 1.0), (1.0, 2.0), (1.0, 2.0)]


def by_hand(values, bins):
    lo, hi = min(values), max(values)
    width = (hi - lo) / (bins - 1)
    counts = [0] * bins
    for v in values:
        counts[max(math.ceil((v - (lo - width / 2)) / width) - 1, 0)] += 1
    return counts


def test_histogram_bins(spark):
    values = [1.0, 2.0, 2.0, 3.5, 10.0, 33.0]
    got = rows(d.histogram(frame(spark, values), "x", 5, log10=False), "bin")
    assert [x[3] for x in got] == by_hand(values, 5)
    assert got[0][1] + got[0][2] == pytest.approx(2 * min(values))  # centred on the minimum
    assert sum(x[4] for x in got) == pytest.approx(1)
    logs = rows(d.histogram(frame(spark, values + [0.0, -3.0]), "x", 4), "bin")
    assert [x[3] for x in logs] == by_hand([math.log10(v) for v in values], 4)


def test_histogram_of_groups_shares_its_bins(spark):
    values, groups = [1.0, 2.0, 9.0, 4.0], ["a", "a", "b", "b"]
    got = rows(d.histogram(frame(spark, values, groups), "x", 3, log10=False, by=["g"]), "g", "bin")
    assert [(x[0], x[1], x[4]) for x in got] == [("a", 0, 2), ("a", 1, 0), ("a", 2, 0), ("b", 0, 0), ("b", 1, 1), ("b", 2, 1)]


def test_histogram_of_one_value_and_of_none(spark):
    assert [x[3] for x in rows(d.histogram(frame(spark, [5.0, 5.0]), "x", 18))] == [2]
    assert rows(d.histogram(frame(spark, [-1.0]), "x", 18)) == []


def test_density_near_the_exact_sum(spark):
    rng = np.random.default_rng(2)
    x = rng.lognormal(3, 1, 400)
    logs = np.log10(x)
    q1, q3 = np.quantile(logs, [0.25, 0.75])
    bw = 0.9 * min(logs.std(ddof=1), (q3 - q1) / 1.34) * len(x) ** -0.2
    got = rows(d.density(frame(spark, [float(v) for v in x]), "x"), "point")
    assert len(got) == 512
    at = np.array([g[1] for g in got])
    exact = np.exp(-0.5 * ((at[:, None] - logs) / bw) ** 2).sum(1) / (len(x) * bw * math.sqrt(2 * math.pi))
    assert np.abs(np.array([g[2] for g in got]) - exact).max() < 2e-3
    assert at[0] == pytest.approx(logs.min()) and at[-1] == pytest.approx(logs.max())


def test_density_of_groups(spark):
    rng = np.random.default_rng(4)
    x = [float(v) for v in rng.lognormal(1, 1, 200)]
    groups = ["a", "b"] * 100
    got = rows(d.density(frame(spark, x + [3.0], groups + ["single"]), "x", ["g"], points=64), "g", "point")
    assert {g[0] for g in got} == {"a", "b"}  # one value has no spread to estimate
    assert len(got) == 128


# statistics -----------------------------------------------------------------------------------


def test_moments_and_quantile(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0.001, 0.05, 300)
    df = frame(spark, [float(v) for v in x])
    c = F.col("x")
    var, mod, down = df.agg(stats.historical_var(c), stats.modified_var(c), stats.downside_deviation(c)).first()
    m, s = x.mean(), x.std()
    sk, ku = ((x - m) ** 3).mean() / s**3, ((x - m) ** 4).mean() / s**4 - 3
    z = stats.Z_05
    assert var == pytest.approx(np.quantile(x, 0.05))
    assert mod == pytest.approx(m + s * (z + (z**2 - 1) * sk / 6 + (z**3 - 3 * z) * ku / 24 - (2 * z**3 - 5 * z) * sk**2 / 36))
    assert down == pytest.approx(math.sqrt((np.minimum(x, 0) ** 2).mean()))


def test_beta_and_correlation_by_side(spark):
    rng = np.random.default_rng(8)
    b = rng.normal(0, 1, 200)
    a = 1.5 * b + rng.normal(0, 0.3, 200)
    df = spark.createDataFrame([(float(i), float(j)) for i, j in zip(a, b)], "a double, b double")
    ca, cb = F.col("a"), F.col("b")
    got = df.agg(
        stats.beta(ca, cb), stats.beta(ca, cb, "up"), stats.beta(ca, cb, "down"),
        stats.corr_side(ca, cb), stats.corr_side(ca, cb, "down"), stats.beta(cb, cb),
    ).first()

    def slope(keep):
        return np.cov(a[keep], b[keep])[0, 1] / b[keep].var(ddof=1)

    every = np.ones(200, bool)
    want = (slope(every), slope(b > 0), slope(b < 0), np.corrcoef(a, b)[0, 1], np.corrcoef(a[b < 0], b[b < 0])[0, 1], 1.0)
    assert tuple(got) == pytest.approx(want)


def test_constant_and_single_series_have_no_beta(spark):
    df = spark.createDataFrame([("c", 0.1, 0.2), ("c", 0.3, 0.2), ("s", 0.1, 0.2)], "k string, a double, b double")
    got = rows(df.groupBy("k").agg(stats.beta(F.col("a"), F.col("b")), stats.corr_side(F.col("a"), F.col("b"))))
    assert got == [("c", None, None), ("s", None, None)]
