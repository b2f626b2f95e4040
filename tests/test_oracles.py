"""Every core query against its SQL oracle on the smallest tables."""

import pytest
from oracle import compare, connect

from quireflow.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_oracle(spark, sf, con, name):
    compare(spark, sf, con, registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_oracle_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0
