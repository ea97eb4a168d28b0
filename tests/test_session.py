"""Joins with hot keys, rows kept once, measured broadcasts."""

import pytest

from tallyforge import session as S


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("limit,salts", [(None, None), (-1, None), (-1, 5)])
def test_spread_join_equals_a_join(spark, how, limit, salts):
    big = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, 7, IF(id % 50 = 1, NULL, id % 40)) AS k")
    small = spark.range(20).selectExpr("id AS k", "id * 2 AS v")
    got = sorted(map(str, S.spread_join(big, small, ["k"], "id", how, limit, salts).select("id", "k", "v").collect()))
    assert got == sorted(map(str, big.join(small, ["k"], how).select("id", "k", "v").collect()))


def test_once(spark, monkeypatch):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, None), (2, None), (None, "c"), (None, "c"), (3, "d")]
    df = spark.createDataFrame(rows, "k long, t string")
    want = sorted(map(str, set(rows)))
    assert sorted(str(tuple(r)) for r in S.once(df, "k").collect()) == want
    monkeypatch.setattr(S, "BROADCAST_BYTES", -1)
    assert sorted(str(tuple(r)) for r in S.once(df, "k").collect()) == want
    assert S.once(df.limit(0), "k").count() == 0


def test_sizes_are_bytes(spark):
    assert S.bytes_of(spark.createDataFrame([("é",)], "x string")) > S.bytes_of(spark.createDataFrame([("e",)], "x string"))
