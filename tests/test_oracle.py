"""Every registered query that has a DuckDB oracle against it, on the sf0.01 driver tables."""

import os

import pytest

import __spark_entry__ as E
from check_oracle import compare, duck
from jarledger.plans.catalog import QUERIES

SF = os.environ.get("JARLEDGER_TEST_SF", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["box_id", "point", "day", "label", "balance"]


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, key):
    r = compare(spark, con, key, E.queries()[key], E.oracle_sql()[key], SF)
    assert r["ok"], r
