import pytest

import oracle
from knotwork.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    n, different = oracle.differences(spark, sf, registry.queries()[name], registry.oracle_sql()[name])
    assert not different
