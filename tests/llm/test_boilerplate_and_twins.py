"""Repeated lines and formatting twins, against brute force and on odd inputs."""

import random
import re

from tallyforge.llm import boilerplate as B
from tallyforge.llm import twins as W

WORDS = "alpha beta gamma delta epsilon zeta theta kappa lambda omega".split()


def plain(x):
    return re.sub(r"[\W\d_]+", "", x.lower())


def brute_lines(rows, least=5, share=0.2):
    docs, ids = {}, {}
    for k, src, text in set(rows):
        if src is None or not src.strip():
            continue
        docs.setdefault(src.strip().lower(), set()).add(k)
        for n, line in enumerate((text or "").split("\n"), 1):
            if text is not None and len(re.sub(r"\s+", " ", line.strip())) >= 30:
                ids.setdefault((src.strip().lower(), plain(line)), set()).add((k, n))
    return {x for (src, _), at in ids.items() if len({k for k, _ in at}) >= max(least, share * len(docs[src])) for x in at}


def corpus(seed, n=150):
    r = random.Random(seed)
    sentence = lambda: " ".join(r.choices(WORDS, k=9))
    shared = {s: [sentence() for _ in range(5)] for s in ("acme", "beta", "tiny")}
    rows = []
    for k in range(n):
        s = r.choice(["acme"] * 6 + ["beta", "tiny"])
        lines = [sentence() for _ in range(4)] + [x if r.random() < 0.7 else x.upper() + " 12!" for x in shared[s] if r.random() < 0.4]
        r.shuffle(lines)
        rows.append((k, r.choice([s, s.upper(), f" {s} "]), "\n".join([*lines, "short", *lines[:1]])))
    return rows + rows[:7] + [(900, None, "x"), (901, " ", "y" * 40), (902, "acme", None), (903, "acme", "")]


def test_repeated_lines_equal_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(*x, "c") for x in rows], "k long, s string, t string, src string")
        got = {(r.k, r.line_no) for r in B.repeated_lines(df, "k", "s", "t").collect()}
        assert got == brute_lines(rows) and got


def test_batches_and_partitions_do_not_matter(spark):
    rows = corpus(3, 300)
    df = spark.createDataFrame(rows, "k long, s string, t string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.k, r.line_no) for r in B.repeated_lines(df, "k", "s", "t").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == brute_lines(rows)


def test_longer_blocks_are_found_and_cleaned(spark):
    block = ["this is the first of two lines that always come", "and this is the second of those two lines here"]
    rows = [(k, "s", "\n".join([f"own line of document number {'x' * k} and more words", *block])) for k in range(6)]
    df = spark.createDataFrame(rows, "k long, s string, t string")
    blocks = B.repeated_blocks(B.documents_with_ids(df, "k", "s", "t")).collect()
    assert sorted((b.k, b.docs) for b in blocks) == [(1, 6), (1, 6), (2, 6)]
    assert [(b.k, b.docs) for b in B.maximal_blocks(B.repeated_blocks(B.documents_with_ids(df, "k", "s", "t"))).collect()] == [(2, 6)]
    clean = {r.k: (r.clean_text, r.removed) for r in B.without_repeated_lines(df, "k", "s", "t").collect()}
    assert clean[3] == ("own line of document number xxx and more words", 2)


def brute_blocks(rows, need):
    """{(lines, documents)} of the blocks that stand in `need` documents, of one source."""
    counts = {}
    for k, _, text in rows:
        ids = [plain(x) if len(x) >= 30 else "" for x in text.split("\n")]
        found = {tuple(ids[a:b]) for a in range(len(ids)) for b in range(a + 1, len(ids) + 1) if all(ids[a:b])}
        for block in found:
            counts.setdefault(block, set()).add(k)
    return sorted((len(b), len(d)) for b, d in counts.items() if len(d) >= need)


def test_blocks_of_any_length_equal_brute_force(spark):
    r = random.Random(8)
    notice = [f"this is line number {'i' * n} of a notice that goes on and on" for n in range(30)]
    rows = []
    for k in range(24):
        a = r.randrange(0, 12)
        part = notice[a : a + r.randrange(3, 30)]
        own = [f"a line that stands in one document only {'x' * (k + 1)}"]
        rows.append((k, "s", "\n".join(r.choice([part + own, own + part, part + own + part[:4], part + ["short"] + part[1:5]]))))
    df = spark.createDataFrame(rows, "k long, s string, t string")
    blocks = B.repeated_blocks(B.documents_with_ids(df, "k", "s", "t"), min_docs=5, min_share=0.2).collect()
    assert sorted((b.k, b.docs) for b in blocks) == brute_blocks(rows, 5) and max(b.k for b in blocks) > 8


def test_least_lines(spark):
    pair, lone = ["this is the first of two lines that always come", "and this is the second of those two lines here"], "a line that comes alone, with others around it"
    rows = [(k, "s", "\n".join([*pair, f"own line of document number {'x' * k} and more words", lone, "short"])) for k in range(6)]
    df = spark.createDataFrame(rows + [(9, "s", lone), (9, "s", pair[1])], "k long, s string, t string")
    lines = lambda n: sorted((r.k, r.line_no) for r in B.repeated_lines(df, "k", "s", "t", least_lines=n).collect())
    assert lines(1) == sorted([(k, n) for k in range(6) for n in (1, 2, 4)] + [(9, 1)])
    assert lines(2) == sorted((k, n) for k in range(6) for n in (1, 2)) and lines(3) == []


def test_empty_lines_table(spark):
    df = spark.createDataFrame([], "k long, s string, t string")
    assert B.repeated_lines(df, "k", "s", "t").count() == 0 and B.without_repeated_lines(df, "k", "s", "t").count() == 0


HEAD = {"Level": "senior", "Team": "support desk", "Location": "Oakford"}


def posting(labels, body, flat=False):
    lines = [f"{k}: {HEAD[k]}" for k in labels] + body
    return " ".join(lines) if flat else "\n".join(lines)


def test_twins(spark):
    body = ["We look for people who have shipped things.", "• 4 years of Kafka, and 8 years of Go"]
    rows = [
        (1, posting(["Level", "Team", "Location"], body)), (2, posting(["Team", "Location", "Level"], [x.upper().replace(",", "") for x in body])), (3, posting(["Location", "Level", "Team"], body, flat=True)),
        (4, posting(["Level", "Team", "Location"], [body[0], "• 8 years of Kafka, and 4 years of Go"])), (5, posting(["Level", "Team"], body)), (6, posting(["Team", "Level", "Location"], body[::-1])),
        (7, None), (8, ""), (9, "..."), (10, "no labels at all, just text"), (11, "No labels at all -- just text"), (12, posting(["Team", "Level", "Location"], body, flat=True) + "\n\n"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(*rows[0], "x"), (*rows[3], "x")], "k long, t string, class_id string")
    got = {r.k: (r.class_id, r.copies) for r in W.twin_classes(df, "k", "t").collect()}
    assert got == {1: (1, 4), 2: (1, 4), 3: (1, 4), 12: (1, 4), 4: (4, 1), 5: (5, 1), 6: (6, 1), 7: (7, 1), 8: (8, 1), 9: (9, 1), 10: (10, 2), 11: (10, 2)}


def twins_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    return [r.class_id for r in W.twin_classes(df, "k", "t").sort("k").collect()]


LONG = {"Level": "senior or staff, whichever of the two suits you best", "Team": "support desk", "Location": "Oakford or Millhaven, with two days a week at home"}


def long_posting(labels, body, sep="\n"):
    return sep.join([f"{k}: {LONG[k]}" for k in labels] + body)


def test_values_of_any_length(spark):
    body = ["We look for people who have shipped things.", "You get time to do it well, and colleagues who help."]
    lined = [long_posting(x, body) for x in (["Team", "Location", "Level"], ["Level", "Location", "Team"], ["Location", "Level", "Team"])]
    assert twins_of(spark, lined) == [0, 0, 0]
    flat = [long_posting(x, body, " ") for x in (["Team", "Location", "Level"], ["Level", "Team", "Location"])]
    assert twins_of(spark, [lined[1], *flat]) == [0, 0, 0]
    assert twins_of(spark, flat) == [0, 0]
    half = [long_posting(["Location", "Team"], [f"Level: {LONG['Level']} {body[0]}", body[1]]), long_posting(["Level", "Team"], [f"Location: {LONG['Location']} {body[0]}", body[1]])]
    assert twins_of(spark, half) == [0, 0] and twins_of(spark, [*half, lined[0]]) == [0, 0, 0]


def test_what_moves_in_the_body_is_no_twin(spark):
    heads, notes = ["Level: senior", "Team: support desk"], ["Kafka: four years of it or more, all in production", "Go: eight years"]
    bodies = [["We look for people who have shipped things and more.", *notes], ["We look for people who have shipped things and more.", *notes[::-1]]]
    lined, flat = ["\n".join(heads + b) for b in bodies], [" ".join(heads + b) for b in bodies]
    names = ["Kafka: x\nGo: y\nother text"]
    assert twins_of(spark, [*lined, *flat, *names]) == [0, 1, 0, 1, 4]


def test_rare_labels(spark):
    rows = ["Level: x\nTeam: y\nText of number " + str(i) for i in range(400)]
    body = "We look for people who have shipped things."
    rare = [f"Guild: red\nLevel: senior\nTeam: desk\n{body}", f"Level: senior\nTeam: desk\nGuild: red\n{body}", f"Team: desk\nGuild: red\nLevel: senior\n{body}", f"Level: senior Guild: red Team: desk {body}"]
    assert twins_of(spark, rows + rare)[400:] == [400] * 4
    assert twins_of(spark, rows + rare[:1] + [rare[3]])[400:] == [400] * 2
    assert twins_of(spark, rows + [rare[3], f"Guild: red Team: desk Level: senior {body}"])[400:] == [400] * 2


def test_twins_of_empty_and_hot_groups(spark):
    df = spark.createDataFrame([], "k long, t string")
    assert W.twin_classes(df, "k", "t").count() == 0
    df = spark.range(3000).selectExpr("id AS k", "IF(id % 3 = 0, 'Level: x\nSame text', concat('Level: x\nText ', id, repeat('.', 1 + id % 5))) AS t")
    got = W.twin_classes(df, "k", "t").groupBy("class_id").count().filter("count > 1").collect()
    assert [(r[0], r[1]) for r in got] == [(0, 1000)]
