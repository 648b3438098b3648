"""Every registered batch query against its SQL, over whole small tables."""

import pytest

from millrace.plans.oracle import ORACLES
from millrace.plans.registry import QUERIES

from .oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, con, name):
    compare(QUERIES[name](spark, sf_dir), con, ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_pushed_down_and_pruned(spark, sf_dir):
    """A date pattern reaches the scan as a range, and only the columns that are needed are read."""
    plan = QUERIES["q6_pricing_summary"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan
    assert "l_partkey" not in plan.split("ReadSchema")[1]
