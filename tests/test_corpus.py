"""Aliases of any number of words."""

import pytest

from tallyforge.operators import corpus as C


@pytest.mark.parametrize("most", [20_000, 1])
def test_aliases_of_any_length_are_found(spark, monkeypatch, most):
    monkeypatch.setattr(C, "FIRST_WORDS", most)
    docs = spark.createDataFrame([(1, "Head of Data and Machine-Learning Platform Engineering, once head of data"), (2, "machine learning"), (3, None)], "k long, t string")
    terms = spark.createDataFrame([("long", "head of data and machine learning platform engineering"), ("five", "Data and machine learning platform"), ("two", "machine learning"), ("none", " - ")], "term string, alias string")
    got = {tuple(r) for r in C.mentions(docs, "k", "t", terms, "term", "alias").collect()}
    assert got == {(1, "long", 1), (1, "five", 1), (1, "two", 1), (2, "two", 1)}
    assert C.mentions(docs, "k", "t", terms.limit(0), "term", "alias").count() == 0
