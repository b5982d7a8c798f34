"""Every registered query of the keyed engine equals its SQL."""

import pytest
from conftest import rows_of, sql_rows

from keyloom.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, sf_dir, views):
    assert rows_of(QUERIES[name](spark, sf_dir)) == sql_rows(SQL[name], views)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["kmer", "cnt"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_scan_is_pruned(spark, sf_dir):
    from keyloom.plans.queries import map_count

    plan = map_count(spark, sf_dir)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_partkey:bigint>" in plan
    assert "IsNotNull(l_partkey)" in plan
    assert "partial_" in plan
