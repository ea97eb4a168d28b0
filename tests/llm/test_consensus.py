"""Consensus of raters: planted truth, both ways of passing weights, odd inputs."""

import random

import pytest

from tallyforge.llm import consensus as X

RATES = {"good": (0.95, 0.95), "fair": (0.8, 0.8), "lenient": (0.95, 0.35), "wrong": (0.2, 0.2), "noise": (0.5, 0.5)}


def votes(spark, n=400, seed=1):
    r = random.Random(seed)
    truth = {i: r.random() < 0.5 for i in range(n)}
    rows = []
    for i, t in truth.items():
        for who, (yes, no) in RATES.items():
            for _ in range(r.choice([0, 1, 2])):
                rows.append((i, who, t if r.random() < (yes if t else no) else not t))
    df = spark.createDataFrame(rows, "i long, who string, met boolean")
    return truth, rows, X.votes_by_rater(df, ["i"], "who")


def test_planted_truth_beats_majority(spark):
    truth, rows, v = votes(spark)
    items, raters = X.reweighted_consensus(v, ["i"])
    got = {r.i: r.consensus for r in items.collect()}
    acc = {r.rater: r for r in raters.collect()}
    seen = {i for i, _, _ in rows}
    right = sum(got[i] == truth[i] for i in seen) / len(seen)
    plain = sum((sum(m for j, _, m in rows if j == i) * 2 > sum(j == i for j, _, _ in rows)) == truth[i] for i in seen) / len(seen)
    assert right > plain + 0.05 and right > 0.85
    assert acc["good"].accuracy > acc["fair"].accuracy > acc["noise"].accuracy > acc["wrong"].accuracy
    assert acc["wrong"].weight_yes < 0 and acc["lenient"].weight_yes < acc["good"].weight_yes


def test_joined_weights_give_the_same(spark, monkeypatch):
    _, _, v = votes(spark, 60)
    a = {r.i: round(r.score, 6) for r in X.reweighted_consensus(v, ["i"])[0].collect()}
    monkeypatch.setattr(X, "WEIGHTS_AS_CONSTANT", 0)
    assert {r.i: round(r.score, 6) for r in X.reweighted_consensus(v, ["i"])[0].collect()} == a


def test_ties_empty_and_null_raters(spark):
    df = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, None, True)], "i long, who string, met boolean")
    items, _ = X.reweighted_consensus(X.votes_by_rater(df, ["i"], "who"), ["i"])
    assert {r.i: r.consensus for r in items.collect()}[1] is False
    items, raters = X.reweighted_consensus(X.votes_by_rater(df.limit(0), ["i"], "who"), ["i"])
    assert items.count() == 0 and raters.count() == 0


def test_replies(spark):
    good = 'Here: {"resume-craft": {"criteria": [{"id": "resume-craft/C1", "answer": "No."}, {"id": " c2 ", "answer": true}, {"id": "C2", "answer": false}, {"id": "C3", "answer": "unclear"}, {"id": "X1", "answer": "yes"}]}, "tone": {"criteria": [{"id": "C1", "answer": "yes"}]}, "agentic-systems": {"score": 3}}'
    rows = [(1, good, "x"), (2, None, "x"), (3, "{half", "x"), (4, "", "x")]
    df = spark.createDataFrame(rows, "k long, reply string, met string")
    assert sorted((r.k, r.criterion_id, r.met) for r in X.reply_answers(df, ["k"], "reply", ["resume-craft", "agentic-systems"], ["C1", "C2", "C3"]).collect()) == [(1, "resume-craft/C1", False), (1, "resume-craft/C2", True)]


def test_alpha(spark):
    rows = [(1, "a", True), (1, "b", True), (2, "a", True), (2, "b", False), (3, "a", False), (3, "b", False), (4, "a", True)]
    df = spark.createDataFrame([("g", *r) for r in rows], "g string, i long, who string, met boolean")
    v = X.votes_by_rater(df, ["g", "i"], "who")
    row = X.nominal_alpha(v, ["g"]).first()
    assert (row["items"], row.answers) == (3, 6) and row.alpha == pytest.approx(1 - 5 * 2 / 18)
    same = X.votes_by_rater(df.filter("met"), ["g", "i"], "who")
    assert X.nominal_alpha(same, ["g"]).first().alpha is None
