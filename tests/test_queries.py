"""Every registered query against its SQL on the smallest benchmark tables."""

import pytest

import __spark_entry__ as entry
from tests.check import compare, connect
from tidewell.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    outcome, n = compare(spark, con, sf_dir, name)
    assert not outcome, outcome


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(ORACLES) == set(QUERIES)


def test_entry(spark, sf_dir):
    df = entry.entry(spark)
    assert df.columns[:2] == ["week", "vault"] and df.count() > 0
