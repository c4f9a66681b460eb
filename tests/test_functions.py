import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewell.functions import calendar as cal
from tidewell.functions import names, nulls


def one(df, c):
    return df.select(c.alias("v")).first()[0]


def test_sum_is_missing_when_an_input_is(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 3.0)], "k string, v double")
    assert rows(df.groupBy("k").agg(nulls.sum_strict("v"))) == [("a", None), ("b", 5.0)]


def test_running_values_stay_missing_after_a_gap(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0), (3, None), (4, 1.0)], "t int, v double")
    w = Window.orderBy("t")
    out = df.select(
        "t",
        nulls.running_sum_strict(F.col("v"), w).alias("s"),
        nulls.running_max_strict(F.col("v"), w).alias("m"),
        nulls.lagged_product_strict(F.col("v"), w).alias("p"),
    )
    assert rows(out, "t") == [(1, 2.0, 2.0, 1.0), (2, 5.0, 3.0, 2.0), (3, None, None, 6.0), (4, None, None, 1.0)]


def test_least_and_greatest_of_a_missing_value(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, None)], "a double, b double")
    got = rows(df.select("b", nulls.least_strict(F.col("a"), F.col("b")), nulls.greatest_strict(F.col("a"), F.col("b"))))
    assert got == [(2.0, 1.0, 2.0), (None, None, None)]


def test_choice_division_and_empty_text(spark):
    df = spark.createDataFrame([(None,)], "x int")
    assert one(df, nulls.if_else(F.col("x") > 1, F.lit("y"), F.lit("n"))) is None
    assert one(df, nulls.safe_div(F.lit(1), F.lit(0))) is None
    assert one(df, nulls.safe_div(F.lit(1.5), F.lit(3))) == 0.5
    assert one(df, nulls.empty_to_null(F.lit(""))) is None


@pytest.mark.parametrize(
    "ts, friday",
    [("2022-01-06 23:59:59", "2021-12-31"), ("2022-01-07 00:00:00", "2022-01-07"), ("2022-01-13 12:00:00", "2022-01-07"),
     ("1969-12-31 00:00:00", "1969-12-26")],
)
def test_week_from_friday(spark, ts, friday):
    df = spark.createDataFrame([(dt.datetime.fromisoformat(ts),)], "ts timestamp_ntz")
    assert one(df, cal.week_floor("ts")) == dt.date.fromisoformat(friday)


@pytest.mark.parametrize(
    "ts, sunday",
    [("2022-01-09 00:00:00", "2022-01-09"), ("2022-01-09 00:00:01", "2022-01-16"), ("2022-01-08 10:00:00", "2022-01-09")],
)
def test_week_up_to_sunday(spark, ts, sunday):
    df = spark.createDataFrame([(dt.datetime.fromisoformat(ts),)], "ts timestamp_ntz")
    assert one(df, cal.week_ceiling("ts")) == dt.date.fromisoformat(sunday)


def test_weeks_do_not_depend_on_the_time_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2022, 3, 27, 2, 30),)], "ts timestamp_ntz")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("Pacific/Auckland", "America/Los_Angeles", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert one(df, cal.week_floor("ts")) == dt.date(2022, 3, 25)
            assert one(df, cal.week_ceiling("ts")) == dt.date(2022, 4, 3)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_months_cuts_and_look_back(spark):
    days = [dt.datetime(2022, 1, 1) + dt.timedelta(days=i) for i in range(400)]
    df = spark.createDataFrame([(d,) for d in days], "ts timestamp_ntz")
    assert cal.starting(df, "ts", "2022-01-02", "2022-01-05").count() == 4
    assert cal.starting(df, "ts", None).count() == 400
    assert cal.since(df, "ts", "2023-01-01").agg(F.min("ts")).first()[0] == dt.datetime(2022, 1, 2)
    assert one(df.limit(1).select(F.lit("2022-02-17").cast("date").alias("d")), cal.month_floor("d")) == dt.date(2022, 2, 1)


@pytest.mark.parametrize(
    "pool, chain, token, short, short_chain",
    [
        ("BTC.BTC", "BTC", "BTC", "BTC.BTC", "BTC"),
        ("ETH.USDC-0XA0B8", "ETH", "USDC", "ETH.USDC", "ETH"),
        ("BNB.BUSD-BD1", "BNB", "BUSD", "BNB.BUSD", "BNB"),
        ("RUNE", "RUNE", None, "RUNE", None),
        ("", None, None, "", None),
    ],
)
def test_pool_names(spark, pool, chain, token, short, short_chain):
    df = spark.createDataFrame([(pool,)], "p string")
    p = F.col("p")
    got = df.select(
        names.pool_chain(p), names.pool_token(p), names.pool_short_name(p), names.short_name_chain(names.pool_short_name(p))
    ).first()
    assert tuple(got) == (chain, token, short, short_chain)


def test_asset_and_coin_spellings(spark):
    df = spark.createDataFrame([("BTC/BTC", "terra-luna"), ("BTC.BTC", "avalanche-2")], "a string, c string")
    got = rows(df.select(names.canonical_asset(F.col("a")), names.coin_alias(F.col("c"))))
    assert got == [("BTC.BTC", "avalanche"), ("BTC.BTC", "luna")]


def test_display_formats(spark):
    df = spark.createDataFrame([(0.12345, -1234.5, 7)], "a double, b double, c int")
    assert df.select(names.percent(F.col("a"), 2), names.dollar(F.col("b"), 1)).first()[:] == ("12.35%", "-$1,234.5")
    assert names.format_numeric(df).first()[:] == ("0.12", "-1234", 7)
    df = spark.createDataFrame([(0.001234, 0.0999, 9.99, 0.0, None)], "a double, b double, c double, d double, e double")
    assert names.format_numeric(df).first()[:] == ("0.0012", "0.10", "10", "0.0", None)
