"""Text functions, line scans and scoring on small hand-made inputs."""

from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import corpus as C
from tallyforge.operators import scoring as S
from tallyforge.operators import segments as G


def one(spark, make, value):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first().y


def test_glyph_codes(spark):
    assert one(spark, T.without_glyph_codes, "(cid:127) Built (cid:65)(cid:9999)x (cid:  \nend  ") == "• Built Ax (cid:\nend"


def test_normalised(spark):
    assert one(spark, T.squeezed_lower, "  A\t\nB ") == "a b"
    assert one(spark, T.words, None) == []


def test_cut_at_word(spark):
    assert one(spark, lambda x: T.cut_at_word(x, 9), "one two three") == "one two…"
    assert one(spark, lambda x: T.cut_at_word(x, 4), "abcdefgh") == "abcd…"
    assert one(spark, lambda x: T.cut_at_word(x, 99), "short") == "short"


def test_sections_carry_forward(spark):
    df = spark.createDataFrame([(1, "Name\n\nWORK EXPERIENCE\nx\ny\nSkills & Skills\nz"), (2, None)], "k long, t string")
    got = G.sections(df, "k", "t", {"work experience": "experience", "skills": "skills"}).collect()
    assert sorted((r.section, r.first_line, r.n_lines) for r in got) == [("experience", 3, 2), ("header", 0, 1), ("skills", 6, 1)]


def test_requirements_rescued(spark):
    text = "Duties\nown it\n5 years of Go\n"
    df = spark.createDataFrame([(1, text)], "k long, t string")
    got = G.bucketed(df, "k", "t", {"duties": "^duties$", "required": "^required$"}, "intro", "required", "duties", "years").collect()
    assert sorted((r.line, r.bucket) for r in got) == [("5 years of Go", "required"), ("own it", "duties")]


def test_rejoined_bullets(spark):
    df = spark.createDataFrame([(1, "• one\n  two\nplain\n• three")], "k long, t string")
    got = G.rejoined_bullets(G.numbered_lines(df, "k", "t"), "k").collect()
    assert sorted(r.bullet for r in got) == ["one two", "three"]


def test_runs_and_gap(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate("aabbba")] + [(1, 6, None), (1, 7, None)], "k long, i long, v string")
    assert sorted((r.first, r.length, r.value) for r in G.runs(df, "k", ["i"], "v").collect()) == [(1, 2, "a"), (3, 3, "b"), (6, 1, "a"), (7, 2, None)]
    xs = spark.createDataFrame([(1, x) for x in (0, 5, 10, 12)], "k long, x long")
    assert tuple(G.largest_gap(xs, "k", "x").first()) == (1, 0, 5)


def test_near_duplicate_first_match(spark):
    rows = [(1, 0, "a b c d e f"), (1, 1, "a b c d e f"), (1, 2, "x y z"), (1, 3, "f e d c b a")]
    df = spark.createDataFrame(rows, "k long, i long, t string")
    assert sorted((r.ix, r.first_ix) for r in G.near_duplicates_first(df, "k", ["i"], "t").collect()) == [(1, 0), (3, 0)]


def test_ledger_sums_to_costs(spark):
    rows = [(1, f"r{i}", float(i), 1.0, "A") for i in range(9)] + [(2, "r", None, None, None)]
    df = spark.createDataFrame(rows, "d long, rule string, p double, c double, cat string")
    costs = S.clamped_costs(df, "p", "c", "cat", {"A": 600})
    got = S.ledger(costs, "d", "rule", 3).orderBy("ord").collect()
    assert [r.label for r in got] == ["r6", "r7", "r8", "other"] and sum(r.cost for r in got) == 600 * 3 + 1500
    assert {(r.d, r.cat): r.cost for r in S.deductions(costs, "d", "cat", ["A", "B"]).collect()} == {(1, "A"): 3300, (1, "B"): 0, (2, "A"): 0, (2, "B"): 0}


def test_weights_and_composite(spark):
    df = spark.createDataFrame([(6,), (6,), (5,), (3,)], "n long")
    assert sorted(r.weight for r in S.derived_weights(df, "n", 50.0).collect()) == [7.5, 12.5, 15.0, 15.0]
    parts = spark.createDataFrame([(1, 80.0, 1.0), (1, None, 5.0), (2, None, 1.0)], "d long, s double, w double")
    assert {r.d: r.composite for r in S.weighted_scores(parts, "d", "s", "w").collect()} == {1: 80.0, 2: None}


def test_mentions_are_whole_words(spark):
    docs = spark.createDataFrame([(1, "A data engineer, the Data-Engineer; dataengineer")], "k long, t string")
    terms = spark.createDataFrame([("x", "Data Engineer"), ("y", "gine")], "n string, a string")
    assert [tuple(r) for r in C.mentions(docs, "k", "t", terms, "n", "a").collect()] == [(1, "x", 2)]
