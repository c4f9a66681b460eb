import datetime as dt
import os

import pytest

from tidewell.session import get_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = get_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip("benchmark tables are not here")
    return SF


@pytest.fixture(scope="session")
def prices(spark):
    """Build a price history from one list of prices per coin, one row per day."""

    def build(start="2022-01-07", **series):
        day0 = dt.datetime.fromisoformat(start)
        rows = [
            (coin, day0 + dt.timedelta(days=i), "usd", p, None, None if p is None else p * 10.0)
            for coin, values in series.items()
            for i, p in enumerate(values)
        ]
        return spark.createDataFrame(
            rows,
            "coin_id string, timestamp timestamp_ntz, vs_currency string, price double, "
            "total_volume double, market_cap double",
        )

    return build


def rows(df, *order):
    """Collected tuples, sorted by the given columns."""
    out = [tuple(r) for r in df.collect()]
    at = [df.columns.index(c) for c in order] or range(len(df.columns))
    return sorted(out, key=lambda r: [(r[i] is None, r[i]) for i in at])
