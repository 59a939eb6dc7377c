"""Every registered query equals its DuckDB text on the given tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, difference

# The smallest scale has no vendor of a second company.
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
QUERIES, ORACLE = entry.core_queries(), entry.core_oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_all_queries_have_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_oracle(spark, con, name):
    assert con.execute(f"select count(*) from ({ORACLE[name]}) x").fetchone()[0] > 0
    df = QUERIES[name](spark, SF_DIR)
    assert difference(df, con, ORACLE[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(bad in plan for bad in ("Cartesian", "NestedLoop", "Python"))


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
