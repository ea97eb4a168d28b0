"""Packed fields: rules on skeletons, whole texts, and an exact round trip."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import packed as P
from tallyforge.operators.packed import split_packed

CASES = [
    ("Java, Go", ["Java", "Go"]),
    ("Languages: • GraphQL\n• 'C, C++ (embedded)'\n• on-call", ["GraphQL", "C, C++ (embedded)", "on-call"]),
    ('SQL,"the ""careful set"" method",Kafka', ["SQL", 'the "careful set" method', "Kafka"]),
    ("TCP/IP / CI/CD|Spark (batch; streaming) ; ;", ["TCP/IP", "CI/CD", "Spark (batch; streaming)"]),
    ("“SQL, incl. window functions” · R&D", ["SQL, incl. window functions", "R&D"]),
    ("don't; 'tis", ["don't", "'tis"]),
    ('open "quote, b', ['open "quote', "b"]),
    ("a (b, c", ["a (b", "c"]),
    ('""; x', ["x"]),
    ("   ", []),
    ("", []),
    (None, []),
    ("one", ["one"]),
    ("a\tb\nc", ["a", "b", "c"]),
]


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "k long, t string, item string")
    out = {}
    for r in split_packed(df, "k", "t").collect():
        out.setdefault(r.k, {})[r.item_pos] = r.item
    return [[v for _, v in sorted(out.get(i, {}).items())] for i in range(len(texts))]


def test_cases(spark):
    assert run(spark, [t for t, _ in CASES]) == [v for _, v in CASES]


def test_positions_from_one_and_repeats_once(spark):
    df = spark.createDataFrame([(1, "a,b")] * 3, "k long, t string")
    assert sorted(map(tuple, split_packed(df, "k", "t").collect())) == [(1, 1, "a"), (1, 2, "b")]
    assert split_packed(df.limit(0), "k", "t").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_round_trip(spark, seed):
    r = random.Random(seed)
    pieces = ["Java", "C#", "R&D", "node.js", "TCP/IP", "vector search", "x (a, b)", "C++"]
    texts, wanted = [], []
    for _ in range(300):
        values = [r.choice(pieces) for _ in range(r.randrange(1, 30))]
        if r.random() < 0.4:
            values[0] = 'say "so, now"; yes'
        packed = [('"' + v.replace('"', '""') + '"') if '"' in v or r.random() < 0.2 else v for v in values]
        sep = r.choice([", ", ";", " | ", " / ", "\t", "\n", " • "])
        texts.append(sep.join(packed))
        wanted.append(values)
    assert run(spark, texts) == wanted


def test_very_long_text(spark):
    assert len(run(spark, [", ".join(["value"] * 50_000)])[0]) == 50_000


def by_rule(text):
    """The values by the rule on the whole text's skeleton."""
    tokens = re.findall(r"""[^,;|•·\n\t/"'“”():\s]+|[^\S\n\t]+|[\s\S]""", text)
    shape = "".join("a" if re.match(r"""[^,;|•·\n\t/"'“”():\s]""", t) else " " if t[0] not in "\n\t" and t.isspace() else t for t in tokens)
    out = []
    for a, n, quoted in P.split_rule(shape):
        v = "".join(tokens[a - 1 : a - 1 + n])
        out.append((v.replace('""', '"') if quoted else v).strip())
    return [v for v in out if v]


@pytest.mark.parametrize("seed", [3, 4])
def test_pieces_equal_the_rule_on_whole_texts(spark, seed, monkeypatch):
    r = random.Random(seed)
    texts = ["".join(r.choices(["a", "bc", " ", "  ", ",", ";", "|", "\n", "\t", "/", " / ", '"', '""', "“", "”", "'", "(", ")", ":", "•"], k=r.randrange(1, 24))) for _ in range(1500)]
    want = [by_rule(t) if t.strip() else [] for t in texts]
    assert run(spark, texts) == want
    monkeypatch.setattr(P, "table_or_none", lambda *a, **k: None)
    assert run(spark, texts) == want


def test_deep_brackets_and_distant_apostrophes(spark):
    texts = ["x, (1, (2, (3, (4, (5, (6, 6), 5), 4), 3), 2), 1), y", "a," + " " * 40 + "'b, c', d", "(a, b) (c, d) (e, f) (g, h) (i, j), k"]
    assert run(spark, texts) == [["x", "(1, (2, (3, (4, (5, (6, 6), 5), 4), 3), 2), 1)", "y"], ["a", "b, c", "d"], ["(a, b) (c, d) (e, f) (g, h) (i, j)", "k"]]


def test_skeletons_stay_few(spark, small):
    texts = spark.read.parquet(f"{small}/resumes.parquet").select("skills_text").filter("skills_text IS NOT NULL")
    assert texts.select(F.explode(P.pieces(F.col("skills_text"))).alias("p")).select(P.piece_shape(F.col("p"))).distinct().count() < 40
