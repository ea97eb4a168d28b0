"""Leaked passages against brute force, Myers' distance against the plain recurrence."""

import random

import pytest

from tallyforge import session as S
from tallyforge.llm import leakage as X


def distance_in(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for w in text:
        last, row[0] = row[0], 0
        for i, p in enumerate(pattern, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (p != w))
        best = min(best, row[-1])
    return best


def test_myers_equals_recurrence():
    r = random.Random(2)
    for _ in range(400):
        p, t = ([r.choice("abcd") for _ in range(n)] for n in (r.randrange(1, 12), r.randrange(0, 30)))
        assert X.myers(p, t)[0] == distance_in(p, t)


def made(seed, edits):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randrange(8, 50)))) for i in range(25)]
    docs = []
    for d in range(120):
        ws = r.choices(vocabulary, k=r.randrange(0, 80))
        for _ in range(r.randrange(0, 3)):
            source = r.choice(items)[1].split()
            a = r.randrange(max(1, len(source) - 9))
            part = source[a : a + r.randrange(6, 20)]
            for _ in range(r.randrange(0, edits + 1)):
                part[r.randrange(len(part))] = "changed"
            at = r.randrange(len(ws) + 1)
            ws[at:at] = part
        docs.append((d, r.choice([" ", "\n", ", "]).join(w.upper() if r.random() < 0.2 else w for w in ws)))
    return docs, items


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(*x, 1) for x in docs], "d long, t string, edits int")
    i = spark.createDataFrame([(*x, 1) for x in items], "i long, t string, run int")
    return X.leaked_passages(d, "d", "t", i, "i", "t", **kw).collect()


def test_exact_and_near_passages_equal_brute_force(spark):
    docs, items = made(1, 2)
    want = {}
    for d, t in docs:
        ws = X.words_of(t)
        for i, it in items:
            iw = X.words_of(it)
            e = min((distance_in(iw[s : s + 10], ws) for s in range(len(iw) - 9)), default=99)
            if e <= 1:
                want[d, i] = e
    got = {(r.d, r.i): r.edits for r in run(spark, docs, items) if r.words == 10}
    assert got == want
    assert len(want) > 40 and len(set(want.values())) == 2


def test_joined_pieces_and_small_bitmaps_give_the_same(spark, monkeypatch):
    docs, items = made(3, 2)
    want = {(r.d, r.i, r.edits, r.first_word) for r in run(spark, docs, items)}
    monkeypatch.setattr(X, "MOST_BITS", 10)  # nearly every digest passes
    monkeypatch.setattr(X, "spread_join", lambda a, b, keys, salt: S.spread_join(a, b, keys, salt, limit=0))
    assert {(r.d, r.i, r.edits, r.first_word) for r in run(spark, docs, items)} == want and want


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_other_budgets_equal_brute_force(spark, edits):
    docs, items = made(5, edits)
    want = {}
    for d, t in docs:
        ws = X.words_of(t)
        for i, it in items:
            iw = X.words_of(it)
            e = min((distance_in(iw[s : s + 12], ws) for s in range(len(iw) - 11)), default=99)
            if e <= edits:
                want[d, i] = e
    assert {(r.d, r.i): r.edits for r in run(spark, docs, items, passage=12, edits=edits) if r.words == 12} == want and want


def test_near_passages_of_the_tables_equal_brute_force(spark, small):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").distinct().collect() if r[1]]
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{small}/eval_items.parquet").select("item_id", "text").distinct().collect() if r[1]]
    held = [(d, ws, {" ".join(ws[k : k + 5]) for k in range(len(ws) - 4)}) for d, t in docs for ws in [X.words_of(t)]]
    want = {}
    for i, t in items:
        iw = X.words_of(t)
        for s in range(len(iw) - 9):
            halves = " ".join(iw[s : s + 5]), " ".join(iw[s + 5 : s + 10])
            for d, ws, grams in held:
                if halves[0] in grams or halves[1] in grams:  # one edit leaves one half
                    e = distance_in(iw[s : s + 10], ws)
                    if e <= 1:
                        want[d, i] = min(e, want.get((d, i), 9))
    got = {(r.d, r.i): r.edits for r in run(spark, docs, items) if r.words == 10}
    assert got == want and want


def test_words_broken_at_line_ends():
    assert X.words_of("The vendor's fig-\n  ures, on-call RÉSUMÉ_2") == ["the", "vendor", "s", "figures", "on", "call", "résumé", "2"]


def test_words_of_any_text():
    import re

    r = random.Random(4)
    for _ in range(2000):
        t = "".join(r.choices(["ab", "é", "1", "_", "-", "‐", "\n", "\r\n", " ", "\x0b", "\x1c", "²", "ß", "İ", "-\n", "中", "\u0301"], k=r.randrange(0, 40)))
        assert X.words_of(t) == re.findall(r"[^\W_]+", X._BROKEN.sub("", t).lower())


def test_odd_inputs(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, None), (2, ""), (3, item), (3, item), (4, "one two three four five six seven eight nine"), (5, ("filler word " * 30_000) + item)]
    got = sorted((r.d, r.i, r.first_word) for r in run(spark, docs, [(7, item), (7, item), (8, None), (9, "too short")], edits=0))
    assert got == [(3, 7, 1), (5, 7, 60_001)]
    assert run(spark, docs, []) == [] and run(spark, [], [(7, item)]) == []


def test_short_items_and_keys_of_any_type(spark):
    d = spark.createDataFrame([("doc-a", "Well: the quick brown fox jumps, they say"), ("doc-b", "the quick brown dog jumps")], "d string, t string")
    i = spark.createDataFrame([("i1", "The quick brown fox jumps"), ("i2", "the quick brown"), (None, "the quick brown fox jumps")], "i string, t string")
    assert [tuple(r) for r in X.leaked_passages(d, "d", "t", i, "i", "t").collect()] == [("doc-a", "i1", 0, 5, 2)]
