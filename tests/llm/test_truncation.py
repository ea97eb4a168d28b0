"""Cut texts: planted cuts in a made corpus, decoys, odd inputs."""

import random

from tallyforge import session as S
from tallyforge.llm import leakage as L
from tallyforge.llm import truncation as X

SUBJECTS = "the committee,the workshop,the engineer,our gardener,a neighbour,the librarian".split(",")
VERBS = "described,repaired,questioned,remembered,documented,surrounded".split(",")
OBJECTS = "the mechanical clock,an enormous bridge,several important letters,the abandoned lighthouse,another complicated question".split(",")


def corpus(seed=4, n=900, limit=400):
    r = random.Random(seed)
    rows, cut = [], set()
    for k in range(n):
        text = " ".join(f"{r.choice(SUBJECTS).capitalize()} {r.choice(VERBS)} {r.choice(OBJECTS)} during {r.choice(['winter', 'summer', 'autumn'])}." for _ in range(r.randrange(2, 12)))
        if r.random() < 0.4 and len(text) > limit:
            text = text[:limit]
            if text.rstrip()[-1] not in ".":
                cut.add(k)
        elif r.random() < 0.2:
            text += r.choice(["\nThanks for reading", "\n— the desk", f"\nPage {r.randrange(9)} of 9", "\n}"])
        elif r.random() < 0.1:
            text = text.rstrip(".")
        rows.append((k, r.choice(["a", "b", None]), text))
    return rows, cut


def test_planted_cuts(spark):
    rows, cut = corpus()
    df = spark.createDataFrame([(*x, "c", True) for x in rows], "k long, s string, t string, reason string, is_cut boolean")
    got = X.truncation_evidence(df, "k", "s", "t")
    found = {r.k for r in got.filter("is_cut").collect()}
    assert len(cut) > 100 and len(found & cut) / len(cut) > 0.9 and len(found - cut) <= 0.03 * len(found)
    per = {r.s: r for r in X.truncation_by_source(got, "s").collect()}
    assert set(per) == {"a", "b", None} and sum(r.texts for r in per.values()) == len(rows) and sum(r.cut_texts for r in per.values()) == len(found)


def test_endings(spark):
    rows, _ = corpus()
    odd = [(1001, "s", None), (1002, "s", ""), (1003, "s", "   "), (1004, "s", "Ends well."), (1005, "s", "Ends, the engineer,"), (1006, "s", "broken �"), (1007, "s", "a &am"), (1008, "s", "The committee rem…"), (1009, "s", "It is done! \n"), (1010, "s", "x" * 200_000)]
    df = spark.createDataFrame(rows + odd + odd, "k long, s string, t string")
    got = {r.k: r.reason for r in X.truncation_evidence(df, "k", "s", "t").filter("k > 1000").collect()}
    assert got == {1002: None, 1003: None, 1004: None, 1005: "open", 1006: "character", 1007: "open", 1008: "prefix", 1009: None, 1010: None}


def test_small_bitmaps_and_joins_give_the_same(spark, monkeypatch):
    rows, _ = corpus(6, 300)
    df = spark.createDataFrame(rows, "k long, s string, t string")
    a = {(r.k, r.reason) for r in X.truncation_evidence(df, "k", "s", "t").collect()}
    monkeypatch.setattr(L, "MOST_BITS", 10)
    monkeypatch.setattr(S, "BROADCAST_BYTES", -1)
    assert {(r.k, r.reason) for r in X.truncation_evidence(df, "k", "s", "t").collect()} == a


def test_repeated_rows_change_nothing(spark):
    rows, _ = corpus(9, 250)
    reasons = lambda more: {(r.k, r.reason) for r in X.truncation_evidence(spark.createDataFrame(rows + more, "k long, s string, t string"), "k", "s", "t").collect()}
    assert reasons([]) == reasons(rows[:40]) == reasons(rows[100:] + rows[100:])


def test_copies_under_other_keys_change_nothing(spark):
    rows = [*corpus(9, 250)[0], (900, "s", "It was the engineer rem. All is told."), (901, "s", "A neighbour questioned the engineer rem")]
    copies = [(k + 1000 * n, s if n % 2 else "other", t) for n in range(1, 12) for k, s, t in rows]
    got = [X.truncation_evidence(spark.createDataFrame(x, "k long, s string, t string"), "k", "s", "t") for x in (rows, rows + copies + copies[:100])]
    alone, among = ({(r.k, r.reason) for r in x.collect()} for x in got)
    assert (901, "prefix") in alone and among == {(k + 1000 * n, reason) for k, reason in alone for n in range(12)}


def test_pieces_of_words_are_no_words(spark):
    rows, _ = corpus(n=200, limit=10_000)
    seen = ["The committee rem…", "It was the workshop that rem...", "A neighbour rem…\nThanks for reading", "The desk rem&am", "Our gardener rem-\nembered winter."]
    rows += [(2000 + 10 * n + k, "s", f"In {n} days. {t}") for n in range(4) for k, t in enumerate(seen)]
    df = spark.createDataFrame([*rows, (1000, "s", "It is said that the engineer rem"), (1001, "s", "It is said that the engineer reme")], "k long, s string, t string")
    got = {r.k: r.reason for r in X.truncation_evidence(df, "k", "s", "t").collect()}
    assert got[1000] == got[1001] == "prefix" and got[2000] == got[2001] == "prefix" and got[2003] == "open"


def test_a_line_that_others_continue_is_no_closing_line(spark):
    rows = [(k, "s", f"A long lighthouse stood here in {k}.\nOur clocks in the {w} are fine.\nAn arch, an arch, it was.\nEnd of notes") for k, w in enumerate(["archive", "lighthouse"] * 60)]
    rows += [(1000 + k, "s", f"Number {k} is told.\nOur clocks in the arch") for k in range(4)] + [(2000 + k, "s", f"Number {k} is told.\nWritten under an arch") for k in range(4)]
    got = {r.k: r.reason for r in X.truncation_evidence(spark.createDataFrame(rows, "k long, s string, t string"), "k", "s", "t", min_known=1, min_peak=3).collect()}
    assert {got[k] for k in range(1000, 1004)} == {"length"} and {got[k] for k in [*range(120), *range(2000, 2004)]} == {None}


def test_last_tokens_equal_those_of_the_whole_text():
    r = random.Random(5)
    for _ in range(500):
        t = "".join(r.choices(["word", "a-b", " ", " ", "\n", ".", "...", "12", "%", "’s", ",", "\t"], k=r.randrange(0, 900)))
        assert X.last_tokens(t) == X.tokens_of(t)[-3:]
    assert X.last_tokens("x" * 100_000) == ["x" * 100_000]


def test_empty(spark):
    df = spark.createDataFrame([], "k long, s string, t string")
    assert X.truncation_evidence(df, "k", "s", "t").count() == 0
