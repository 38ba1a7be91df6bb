"""The operators' queries against their SQL, on the smallest tables."""

import pytest

from geodiag.llm import queries
from oracle import compare


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_matches_its_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.SQL[name])
