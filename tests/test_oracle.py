"""Every registered query of the core against its SQL, on the smallest tables."""

import pytest

from quillspan.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, name):
    oracle(spark, registry.QUERIES[name], registry.ORACLE.get(name))
