"""Every registered query with a SQL counterpart, on the smallest test tables."""

import pytest
from oracle import connect, differences

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
# Needs ten items per keyword, which the smallest tables do not have.
EMPTY = {"keyword_positive_rate"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", ORACLES)
def test_matches_sql(spark, con, name):
    found = differences(entry.queries()[name](spark, SF_DIR), con, ORACLES[name])
    assert found == (["no rows"] if name in EMPTY else [])


def test_entry(spark):
    assert entry.entry(spark).count() == 4
    assert set(ORACLES) <= set(entry.queries())
