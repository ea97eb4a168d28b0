"""Mapping typed titles to a list: cases, and the pigeonhole join against brute force."""

import random

from tallyforge import session as S
from tallyforge.llm import titles as X

TAX = [
    (1, "Data Engineer", "Data Engineer", None), (2, "Senior Data Engineer", "Data Engineer", None), (3, "Site Reliability Engineer", "Site Reliability Engineer", ["SRE"]),
    (4, "Senior Site Reliability Engineer", "Site Reliability Engineer", None), (5, "Search Engineer", "Search Engineer", None), (6, "Research Engineer", "Research Engineer", None),
    (7, "Software Engineer", "Software Engineer", ["Programmer"]), (8, "Senior Software Engineer", "Software Engineer", None),
]
CASES = {
    "Data Engineer": 1, "ENGINEER, DATA": 1, "Sr. Data Engr": 2, "Data Enigneer (Senior)": 2, "data eng. / on-site": 1, "SRE, Stonebury": 3, "Senior SRE": 4, "Seniorsite Reliability Eng": 4,
    "Engr., Research": 6, "Serch Engineer": 5, "SeniorProgrammer": 8, "Civil Engineer": -1, "n/a": -1, "!!!": -1, "Engineer, Civil": -1, "Data Engineer, Senior": 2, "x" * 5000: -1,
}


def mapped(spark, rows, tax=TAX):
    ref = spark.createDataFrame(tax, "id long, title string, family string, aliases array<string>")
    df = spark.createDataFrame(rows, "k long, i int, title string, ref_id string, distance string")
    return X.map_to_reference(df, ["k", "i"], "title", ref, "id", "title", "family", "aliases")


def test_cases_nulls_blanks_and_repeats(spark):
    rows = [(n, 0, t, "clash", "clash") for n, t in enumerate(CASES)]
    rows += rows[:3] + [(100, 0, None, None, None), (101, 0, "", None, None), (102, 0, "  ", None, None)]
    got = {r.k: r.id for r in mapped(spark, rows).collect()}
    assert got == {n: want for n, want in enumerate(CASES.values())}


def test_words_without_vowels_whatever_the_size_of_the_list(spark, monkeypatch):
    r = random.Random(8)
    long_list = TAX + [(100 + n, "".join(r.choices("abcdefghijklmnoprst", k=48)), None, None) for n in range(12_000)]
    rows = [(n, 0, t, None, None) for n, t in enumerate(["Sftwr Engnr", "Snr Sftwr Engnr", "Engnr, Dt", "Rsrch Engineer", long_list[-1][1]])]
    found = lambda tax: {r.k: r.id for r in mapped(spark, rows, tax).collect()}
    assert found(TAX) == {0: 7, 1: 8, 2: 1, 3: 6, 4: -1} and found(long_list) == found(TAX) | {4: long_list[-1][0]}
    monkeypatch.setattr(S, "BROADCAST_BYTES", -1)
    assert found(TAX) == {0: 7, 1: 8, 2: 1, 3: 6, 4: -1}


def test_empty_tables(spark):
    assert mapped(spark, []).count() == 0
    assert [r.id for r in mapped(spark, [(1, 0, "Data Engineer", None, None)], []).collect()] == [-1]


def test_pigeonhole_loses_no_pair(spark):
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    refs = [(i, "".join(r.choices(words, k=r.randrange(1, 6))), 0) for i in range(40)]
    refs = list({f: (i, f, z) for i, f, z in refs}.values())
    forms = set()
    for _, f, _ in refs * 4:
        x = list(f)
        for _ in range(r.randrange(0, 5)):
            at = r.randrange(len(x) + 1)
            r.choice([lambda: x.insert(at, "q"), lambda: x and x.pop(min(at, len(x) - 1)), lambda: x and x.__setitem__(min(at, len(x) - 1), "z")])()
        forms.add("".join(x))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    def allowed(n):
        return 0 if n <= 5 else 1 if n <= 9 else 2 if n <= 13 else 4

    want = set()
    for f in forms:
        for i, g, _ in refs:
            d = distance(f, g)
            if f and d <= allowed(len(g)) and (d < 4 or len(g) > 22 or sorted(f) == sorted(g)):
                want.add((f, i, d))
    df = spark.createDataFrame([(f, f, 0) for f in forms if f], "value string, form string, less int")
    got = X.pigeonhole_matches(df, spark.createDataFrame(refs, "ref_id long, form string, lead int"))
    assert {(r.value, r.ref_id, r.distance) for r in got.collect()} == want and len(want) > 60
