import pytest

from quillspan.plans import catalog
from tests.compare import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, name):
    diff, n, m = differences(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF)
    assert not diff and n == m, (diff, n, m)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() >= 0
