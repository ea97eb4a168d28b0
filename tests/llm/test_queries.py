"""Names of this subpackage's queries and a run of each on the smallest tables."""

import pytest

from tallyforge.llm import queries as Q


def test_names():
    assert set(Q.ORACLES) <= set(Q.QUERIES) and all(any(n.startswith(f"p{k}_") for n in Q.QUERIES) for k in (2, 3, 5, 6, 7, 8, 9, 10))


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_runs(spark, small, name):
    df = Q.QUERIES[name](spark, small)
    assert len(df.columns) == len(set(df.columns))
    df.collect()
