"""Every registered query against its SQL twin on the smallest given tables."""

import os

import pytest

import __spark_entry__ as entry_point
from compare import difference, oracle_connection

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables not present")


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(entry_point.queries()))
def test_query(spark, con, name):
    df = entry_point.queries()[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    sql = entry_point.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert difference(df, con, sql) is None


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_no_cross_joins(spark):
    """Row-level plans hold no nested-loop or Cartesian join."""
    for name in ("end_to_end_lazy", "classify_layout", "slice_plan", "apply_corrections", "long_exam_check"):
        plan = entry_point.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
