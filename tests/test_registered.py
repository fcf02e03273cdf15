"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from suite.check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_agrees_with_sql(spark, con, name):
    line = compare(spark, con, SF_DIR, name, queries()[name], oracle_sql().get(name))
    assert not line.startswith("FAIL"), line


def test_entry(spark):
    assert entry(spark).count() > 0
