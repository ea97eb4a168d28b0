"""The contract: names, SQL and a smoke run of every query on the smallest tables."""

import pytest

import __spark_entry__ as entry


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90


def test_flagship(spark, small):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.catalogue.QUERIES))
def test_query_runs(spark, small, name):
    df = entry.queries()[name](spark, small)
    assert len(df.columns) == len(set(df.columns))
    df.collect()
