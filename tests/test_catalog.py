"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import catalog
from catalog.compare import compare, connect

SF_DIR = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF_DIR)
    assert name in catalog.ORACLES
    # A small table may have no rejected rows.
    assert [p for p in compare(df, con, catalog.ORACLES[name]) if p != "no rows"] == []


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
