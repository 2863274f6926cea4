"""Queries of the llm subpackage against their SQL, or at least run, on the smallest tables."""

import pytest

from quillspan.llm import oracle as sql
from quillspan.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, oracle, name):
    oracle(spark, queries.QUERIES[name], sql.ORACLE.get(name))
