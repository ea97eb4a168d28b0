"""Packing: nothing lost, nothing over capacity, little room left; token counts."""

import random

import pytest

from tallyforge.llm import packing as X


RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def pack(spark, sizes, **kw):
    df = spark.createDataFrame([(i, n, "x", 1) for i, n in enumerate(sizes)], "k long, n long, block_id string, position int")
    return X.pack(df, "k", "n", **kw).collect()


def checked(rows, sizes, capacity):
    blocks, items = {}, {}
    for r in rows:
        blocks.setdefault(r.block_id, []).append(r)
        items.setdefault(r.k, []).append(r)
    assert all(sum(r.n_units for r in b) <= capacity and sorted(r.position for r in b) == list(range(len(b))) for b in blocks.values())
    for k, n in enumerate(sizes):
        parts = sorted((r.part, r.first_unit, r.n_units) for r in items.get(k, []))
        assert parts == [(p, p * capacity, min(capacity, n - p * capacity)) for p in range(-(-n // capacity))] if n and n > 0 else not parts
    return len(blocks)


@pytest.mark.parametrize("seed,lot", [(1, 100_000), (2, 300)])
def test_tight_and_whole(spark, seed, lot):
    r = random.Random(seed)
    sizes = [min(5000, max(1, int(r.lognormvariate(5.3, 1.0)))) for _ in range(4000)]
    n = checked(pack(spark, sizes, capacity=2048, lot=lot), sizes, 2048)
    assert n <= 1.02 * sum(sizes) / 2048 + 1


def test_items_that_cannot_share(spark):
    sizes = [1100] * 500
    assert checked(pack(spark, sizes, lot=50), sizes, 2048) == 500


def test_odd_sizes(spark):
    sizes = [0, 2048, 2049, 1, -5, 4096]
    assert checked(pack(spark, sizes), sizes, 2048) == 5
    df = spark.createDataFrame([(1, None), (1, None), (2, 5), (2, 5)], "k long, n long")
    assert [(r.k, r.n_units) for r in X.pack(df, "k", "n").collect()] == [(2, 5)]
    assert X.pack(df.limit(0), "k", "n").count() == 0


def test_best_fit_takes_the_tightest():
    fit = X.BestFit(10)
    for n in (6, 7, 3, 4):
        fit.put(n, [n])
    assert sorted(size for size, _ in fit.take(0, 10)) == [10, 10]


def test_token_counts(spark):
    pytest.importorskip("tiktoken")
    df = spark.createDataFrame([(1, "hello world", 0), (2, "", 0), (3, None, 0), (4, "<|endoftext|>", 0), (1, "hello world", 0)], "k long, t string, n_tokens int")
    got = {r.k: r.n_tokens for r in X.token_counts(df, "k", "t", RANKS).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1


def test_texts_of_one_key_and_size_stay_apart(spark):
    pytest.importorskip("tiktoken")
    df = spark.createDataFrame([("doc-a", "red car"), ("doc-a", "big dog"), ("doc-a", "big dog"), (None, "lone"), ("b", "x " * 3000)], "k string, t string")
    counts = X.token_counts(df, "k", "t", RANKS)
    rows = X.pack(counts, "k", "n_tokens", 2048, text_id="text_id").collect()
    assert sorted((str(r.k), r.part) for r in rows) == [("None", 0), ("b", 0), ("b", 1), ("doc-a", 0), ("doc-a", 0)] and len({(r.k, r.text_id) for r in rows}) == 4
    assert sum(r.n_units for r in rows) == counts.agg({"n_tokens": "sum"}).first()[0]
