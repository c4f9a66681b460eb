import datetime as dt
import json

import pytest

from tidewell.sources import io


def test_names():
    assert [io.snake(n) for n in ("CoinID", "BLOCK_TIMESTAMP", "Block Timestamp", "swapFromName")] == [
        "coin_id", "block_timestamp", "block_timestamp", "swap_from_name",
    ]
    assert [io.upper_camel(n) for n in ("coin_id", "BLOCK_TIMESTAMP")] == ["CoinID", "BlockTimestamp"]


def test_normalize_names(spark):
    df = spark.createDataFrame([(1, 2)], ["BLOCK_TIMESTAMP", "Coin ID"])
    assert io.normalize_names(df).columns == ["block_timestamp", "coin_id"]
    assert io.normalize_names(df, "upper_camel").columns == ["BlockTimestamp", "CoinID"]


EVENT = {"BLOCK_TIMESTAMP": "2022-01-07T10:00:00", "TYPE": "deposit", "VAULT": "SOL", "AMOUNT": 1.5, "ADDRESS": "a"}


@pytest.mark.parametrize("fmt", ["json", "json_array"])
def test_json_dataset(spark, tmp_path, fmt):
    path = tmp_path / "events.json"
    path.write_text(json.dumps([EVENT, EVENT]) if fmt == "json_array" else f"{json.dumps(EVENT)}\n{json.dumps(EVENT)}")
    df = io.read_dataset(spark, "vault_events", str(path), fmt)
    assert df.count() == 2
    assert df.first()[:] == (dt.datetime(2022, 1, 7, 10), "deposit", "SOL", 1.5, "a")


def test_json_with_a_wrong_type_fails(spark, tmp_path):
    path = tmp_path / "events.json"
    path.write_text(json.dumps({**EVENT, "AMOUNT": "many"}))
    with pytest.raises(Exception, match="MALFORMED|BadRecord|FAILFAST|malformed"):
        io.read_dataset(spark, "vault_events", str(path), "json").collect()


def test_prices_are_filtered_in_the_scan(spark, tmp_path, prices, capsys):
    path = str(tmp_path / "prices")
    io.write_result(prices(luna=[float(i) for i in range(1, 31)], btc=[1.0] * 30), path)
    df = io.read_prices(spark, path, ["luna"], 9, "2022-02-01")
    assert df.count() == 10
    df.select("price").explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(vs_currency,usd), GreaterThanOrEqual(timestamp,2022-01-23T00:00)" in plan
    assert "(coin_id" in plan.split("PushedFilters: [")[1].split("\n")[0]
    assert "total_volume" not in plan.split("ReadSchema:")[1].split("\n")[0]


@pytest.mark.parametrize("fmt", ["parquet", "csv", "orc"])
def test_sink_round_trip(spark, tmp_path, fmt):
    path = str(tmp_path / fmt)
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "swapper string, swaps long, part string")
    io.write_result(df, path, fmt=fmt, partition_by=["part"] if fmt == "parquet" else [])
    back = spark.read.option("header", True).format(fmt).load(path)
    assert sorted((r["swapper"], int(r["swaps"])) for r in back.collect()) == [("a", 1), ("b", 2)]


def test_inline_dimension(spark):
    d = io.dim(spark, [("solana", "SOL")], "coin_id string, token string")
    assert d.first()[:] == ("solana", "SOL")
