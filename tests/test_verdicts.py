"""Places, verdicts, keys, costs and caps on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import judging as J
from tallyforge.operators import layout as L
from tallyforge.operators import scoring as S


def test_places(spark):
    a = spark.createDataFrame([(1, "p", True), (1, "p", False), (1, "q", False), (2, "p", True), (3, "p", False), (3, "q", False), (4, "p", None)], "i long, place string, met boolean")
    settled = J.place_answers(a, ["i"], "place", "met")
    assert sorted(tuple(r) for r in settled.collect()) == [(1, "q", False), (2, "p", True), (3, "p", False), (3, "q", False)]
    required = spark.createDataFrame([(i, p) for i in (1, 2, 3, 4) for p in "pq"], "i long, place string")
    assert {r.i: r.met for r in J.any_place(required, settled, ["i"], "place").collect()} == {1: None, 2: True, 3: False, 4: None}


def test_every_group(spark):
    required = spark.createDataFrame([(1, "r1", "a"), (1, "r2", "b"), (2, "r1", "a"), (2, "r2", "b"), (3, "r1", "a"), (3, "r1", "b"), (4, "r1", None)], "i long, role string, place string")
    answers = spark.createDataFrame([(1, "a", True), (1, "b", True), (2, "a", True), (2, "b", False), (3, "a", False)], "i long, place string, met boolean")
    assert {r.i: r.met for r in J.every_group(required, answers, ["i"], "role", "place").collect()} == {1: True, 2: False, 3: None, 4: False}


def test_band_and_spread_verdicts(spark):
    rows = [("s", 1, "a", 2), ("s", 1, "b", 2), ("s", 2, "a", 3), ("s", 2, "b", 2), ("t", 1, "a", 0), ("t", 1, "a", 1), ("u", 1, "a", 0), ("u", 1, "b", 2)]
    df = spark.createDataFrame(rows, "g string, i long, judge string, position int")
    got = {r.g: (r.items, r.exact, r.adjacent, r.far, r.unstable, r.verdict) for r in J.band_verdicts(df, ["i"], "g", "judge", "position").collect()}
    assert got == {"s": (2, 1, 1, 0, 0, "look"), "t": (0, 0, 0, 0, 1, "look"), "u": (1, 0, 0, 1, 0, "FAIL")}
    v = spark.createDataFrame([(1, "a", 50.0), (1, "b", 55.0), (2, "a", 50.0), (2, "b", 57.0), (3, "a", 1.0), (4, "a", 0.0), (4, "b", 9.0)], "i long, judge string, v double")
    assert {r.i: (r.spread, r.verdict) for r in J.spread_verdicts(v, ["i"], "judge", "v").collect()} == {1: (5.0, "pass"), 2: (7.0, "look"), 3: (None, None), 4: (9.0, "FAIL")}


def test_key(spark):
    key = spark.createDataFrame([("d", "C1", True), ("d", "C2", False)], "doc string, c string, answer boolean")
    samples = spark.createDataFrame([("a", 0), ("b", 0)], "judge string, s int")
    answers = spark.createDataFrame([("a", 0, "d", "C1", True), ("a", 0, "d", "C2", True)], "judge string, s int, doc string, c string, met boolean")
    got = {r.judge: (r.matched, r.wrong, r.missing) for r in J.key_score(key, samples, answers, ["doc", "c"], ["judge", "s"]).collect()}
    assert got == {"a": (1, 1, 0), "b": (0, 0, 2)}


def test_costs_caps_and_gates(spark):
    rows = [(1, "x", "A", "major", 1.0), (1, "big", "B", "critical", 1.0), (1, "fraud", "B", "critical", 4.0), (2, "y", None, "major", None)]
    f = spark.createDataFrame(rows, "d long, rule string, category string, severity string, scale double")
    priced = S.finding_costs(f, "rule", "category", "severity", "scale", {"major": 12, "critical": 25}, {"A": 30.0, "B": 20.0}, {"x": 1.5}, ("fraud",))
    assert sorted((r.rule, r.cost) for r in priced.collect()) == [("big", 20.0), ("fraud", 100.0), ("x", 18.0), ("y", 0.0)]
    withheld = spark.createDataFrame([(2, "B")], "d long, category string")
    scores = S.category_scores(priced, "d", "category", {"A": 30.0, "B": 20.0}, withheld)
    assert {(r.d, r.category): r.score for r in scores.collect()} == {(1, "A"): 82.0, (1, "B"): 0.0, (2, "A"): 100.0, (2, "B"): 10.0}
    gates = S.gate_scores(scores, "d", S.lookup("category", {"A": "g", "B": "h"}), ("g", "h", "none")).sort("d").collect()
    assert [(r.g, r.h, r.none) for r in gates] == [(82.0, 0.0, None), (100.0, 10.0, None)]
    composites = spark.createDataFrame([(1, 70.0), (2, 30.0)], "d long, composite double")
    assert {r.d: (r.capped, r.cap_rule) for r in S.capped(composites, f, "d", "rule", {"fraud": 40.0, "y": 60.0}).collect()} == {1: (40.0, "fraud"), 2: (30.0, None)}
    held = spark.createDataFrame([("critical", "heuristic"), ("minor", "heuristic"), ("major", "rule")], "s string, p string").select(S.capped_severity(F.col("s"), F.col("p"), {"heuristic": "minor"}, ("critical", "major", "minor")).alias("x"))
    assert [r.x for r in held.collect()] == ["minor", "minor", "major"]


def test_budget(spark):
    prompts = spark.createDataFrame([("a", 1000), ("a", 2000), ("b", 10)], "g string, n int")
    costs = S.worst_case(prompts, "g", "n", 1, 1, 1.0, 2.0, 1000)
    got = {r.g: (r.documents, round(r.dollars, 6), r.fits, r.largest_cap) for r in S.largest_cap(costs, 0.005, 1, 1, 2.0, 1000).collect()}
    assert got == {"a": (2, 0.007, False, 500), "b": (1, 0.00201, True, 2495)}
    with pytest.raises(ValueError):
        S.worst_case(prompts, "g", "n", -1, 1, 1.0, 2.0, 1000)


def test_page_layout(spark):
    words = spark.createDataFrame([(1, 0, 10.0), (1, 0, 22.0), (1, 0, 34.0), (1, 0, 34.0), (1, 0, 200.0), (1, 1, 5.0)], "doc_id long, page int, top double")
    assert [tuple(r) for r in L.line_spacing(words).collect()] == [(1, 12.0)]
    docs, hidden = spark.createDataFrame([(1, "a secret b secret"), (2, "open")], "doc_id long, text string"), spark.createDataFrame([(1, "secret")], "doc_id long, span string")
    assert {r.doc_id: (r.visible, r.dropped) for r in L.visible_text(docs, hidden).collect()} == {1: ("a   b  ", 1), 2: ("open", 0)}
