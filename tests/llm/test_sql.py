"""Operators that SQL can express, against it, over whole small tables."""

import pytest

from millrace.llm import registry

from ..oracle import compare, connect


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    compare(registry.QUERIES[name](spark, sf_dir), connect(sf_dir), registry.ORACLES[name])


def test_names():
    assert {x.split("_")[0] for x in registry.QUERIES} == {f"op{i}" for i in range(1, 11)} | {"pipeline"}
