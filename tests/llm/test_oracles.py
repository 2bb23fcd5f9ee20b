import pytest

import oracle
from knotwork.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    n, different = oracle.differences(spark, sf, queries.queries()[name], queries.oracle_sql()[name])
    assert not different and n
