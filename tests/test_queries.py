"""Every registered query outside the optional subpackages: against its SQL, or at least to its end."""

import os

import pytest
from oracle import SF, assert_same

from cairnstat.plans import registry


@pytest.mark.parametrize("name", sorted(set(registry.SQL) - {n for n in registry.SQL if n.startswith("p3_")}))
def test_against_sql(spark, name):
    assert_same(spark, registry.QUERIES[name], registry.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, os.environ.get("TEST_SF_DIR", SF))
    assert len(set(df.columns)) == len(df.columns)
    df.count()
