import pytest
from conftest import SF
from oracle import differing

from ripplecast.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_duckdb(spark, name):
    assert differing(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF) == 0


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
