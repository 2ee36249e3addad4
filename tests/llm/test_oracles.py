"""The queries that SQL can express, against their SQL."""

import pytest

from loomwork.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, sf_dir, same_rows, name):
    same_rows(registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name])
