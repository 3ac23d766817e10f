"""Every registered query against its SQL in DuckDB, on the smallest test tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import connect, difference

PATH = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(PATH), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(PATH)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, PATH)
    if name in oracle_sql():
        assert difference(df, duck, oracle_sql()[name]) is None
    else:
        df.collect()


def test_oracle_keys_are_queries():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    assert entry(spark).count() > 0

