"""Agreement statistics on hand-made ratings."""

import pytest

from tallyforge.operators import judging as J
from tallyforge.operators.replies import read_replies

#: Three raters of twelve units, None where a rater gave no value.
A = [1, 2, 3, 3, 2, 1, 4, 1, 2, None, None, None]
B = [1, 2, 3, 3, 2, 2, 4, 1, 2, 5, None, 3]
C = [None, 3, 3, 3, 2, 3, 4, 2, 2, 5, 1, None]


def ratings(spark):
    rows = [(u, v) for rater in (A, B, C) for u, v in enumerate(rater) if v is not None]
    return spark.createDataFrame(rows, "u long, v long")


def slow_alpha(rows, distance):
    from collections import defaultdict

    units = defaultdict(list)
    for u, v in rows:
        units[u].append(v)
    units = {u: vs for u, vs in units.items() if len(vs) > 1}
    values = [v for vs in units.values() for v in vs]
    n = len(values)
    do = sum(sum(distance(a, b, values) for a in vs for b in vs) / (len(vs) - 1) for vs in units.values())
    de = sum(distance(a, b, values) for a in values for b in values)
    return 1 - (n - 1) * do / de


def ordinal(a, b, values):
    lo, hi = min(a, b), max(a, b)
    return (sum(values.count(v) for v in range(lo, hi + 1)) - (values.count(lo) + values.count(hi)) / 2) ** 2


@pytest.mark.parametrize("scale,distance", [("nominal", lambda a, b, _: float(a != b)), ("interval", lambda a, b, _: (a - b) ** 2), ("ordinal", ordinal)])
def test_alpha(spark, scale, distance):
    df = ratings(spark)
    got = J.krippendorff(df, ["u"], "v", scale).first()
    assert got.alpha == pytest.approx(slow_alpha([tuple(r) for r in df.collect()], distance), abs=1e-9)


def test_alpha_is_undefined_without_variation(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (2, 2), (2, 2)], "u long, v long")
    assert J.krippendorff(df, ["u"], "v", "nominal").first().alpha is None


def test_majority_tie_is_no_and_silence_is_null(spark):
    df = spark.createDataFrame([(1, True), (1, False), (2, True), (3, None)], "i long, met boolean")
    assert {r.i: r.met for r in J.majority(df, ["i"], "met").collect()} == {1: False, 2: True, 3: None}


def test_leverage_and_totality(spark):
    from tallyforge.plans.judging import BANDS

    table = J.band_table(spark, BANDS)
    assert table.filter("band IS NULL OR band = ''").count() == 0 and table.count() == 160
    got = {(r.scheme, r.criterion): r.flips for r in J.leverage(table).collect()}
    assert [got["agentic-systems", i] for i in range(1, 6)] == [32, 12, 8, 8, 2]
    assert [got["ai-assisted-coding-fluency", i] for i in range(1, 6)] == [32, 8, 8, 4, 4]


def test_compared_has_all_statuses(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k long, v string")
    b = spark.createDataFrame([(1, "x"), (2, "q"), (4, "w")], "k long, v string")
    assert {r.k: r.status for r in J.compared(a, b, ["k"], "v").collect()} == {1: "carried", 2: "changed", 3: "gone", 4: "new"}


def test_replies(spark):
    reply = 'Sure:\n{"s": {"criteria": [{"id": " c1 ", "answer": "maybe"}, {"id": "C1", "answer": true}, {"id": "C1", "answer": "no"}, {"id": "C9", "answer": "yes"}, {"id": "C2", "answer": "n/a"}]}, "other": {"criteria": [{"id": "C1", "answer": "yes"}]}}'
    df = spark.createDataFrame([(1, reply), (2, None), (3, "nothing"), (4, "{broken")], "k long, r string")
    assert [tuple(r) for r in read_replies(df, ["k"], "r", ["s"], ["C1", "C2"]).collect()] == [(1, "s", "C1", True, None)]


def test_spellings_of_replies(spark):
    reply = '{" S ": {"criteria": [{"id": "s/c1", "answer": "Not met."}, {"id": "S/C2 ", "answer": " YES. "}, {"id": "C1", "answer": "yes"}]}, "s": {"criteria": [{"id": "C2", "answer": "no"}]}, "t": {"criteria": null}}'
    df = spark.createDataFrame([(1, reply)], "k long, r string")
    assert sorted(tuple(r)[2:4] for r in read_replies(df, ["k"], "r", ["s", "t"], ["C1", "C2"]).collect()) == [("C1", False), ("C2", True)]


def test_one_complaint_in_three_samples_is_no_vote(spark):
    returned = spark.createDataFrame([(1, "p", s) for s in range(3)], "doc long, provider string, sample int")
    votes = spark.createDataFrame([(1, "c", "p", 0)], "doc long, item string, provider string, sample int")
    assert J.k_of_n(votes, ["doc", "item"], "provider", "sample", 2, returned).count() == 0
    assert J.k_of_n(votes, ["doc", "item"], "provider", "sample", 2, returned.limit(1)).first().confidence == "medium"
