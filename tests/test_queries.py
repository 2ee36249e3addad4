"""Each query of the engine against its SQL in DuckDB, and against nothing where it has none."""

import pytest

import __spark_entry__ as entry
from loomwork.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, sf_dir, same_rows, name):
    same_rows(registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name])


@pytest.mark.parametrize("name", ["default_partitions", "partition_report", "top_k_timing", "bfr_rounds"])
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
