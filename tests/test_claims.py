"""What sentences claim, on hand-made sentences."""

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import claims as C


def over(spark, texts, make):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    return [r.v for r in df.select("k", make(F.col("t")).alias("v")).sort("k").collect()]


def test_metrics(spark):
    texts = ["Cut latency by 40%", "Served 3k requests", "Grew it from 12 to 90", "Worked with 3 engineers", "Used 5 different tools", "No number", "It cost 7", None, "Met 4 people over lunch " + "x" * 40 + " then below 9"]
    assert over(spark, texts, C.has_metric) == [True, True, True, False, False, False, False, False, True]


def test_windows_are_those_around_each_number(spark):
    text = "a" * 40 + " 12 " + "b" * 40 + " 3,4"
    assert over(spark, [text], C.number_windows) == [[text[11:73], text[55:]]]


def test_vacuous(spark):
    assert over(spark, ["Led 3 engineers", "Led 3 engineers, 40% faster", "none"], C.vacuous_number) == ["3 engineers", None, None]


@pytest.mark.parametrize("text,want", [
    ("Cut p99 latency 40% by moving retrieval to FAISS", (True, True, True, True)),
    ("Worked on various tools", (False, False, False, True)),
    ("We improved the system", (True, False, False, False)),
    ("Rewrote ingestion in Airflow with our team", (False, False, True, False)),
    ("Reworked ingestion with our team", (False, False, False, True)),
])
def test_invariants(spark, text, want):
    assert tuple(over(spark, [text], C.invariants)[0]) == want


def test_slop_and_protected_spans(spark):
    hits = lambda t: [h.hit for h in over(spark, [t], lambda c: C.slop_hits(c, "bullet"))[0]]
    assert hits("Leveraged a robust platform, showcasing care") == ["Leveraged", "robust", ", showcasing care"]
    assert hits("Built an eval harness robust to noise at Harness") == [] and hits("A robust plan, robust to noise") == ["robust", "robust"]


def test_audit(spark):
    df = spark.createDataFrame([("Moved ETL to Airflow, 30% faster", t) for t in ("Moved ETL to Airflow, 30% faster", "Moved ETL to Airflow, 45% faster", "Moved it", "Moved ETL to Airflow and Spark and Kafka and Flink, 30% faster")], "a string, b string")
    got = [(r.x.score, list(r.x.problems)) for r in df.select(C.audit(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [(100.0, []), (5.0, ["invented 45", "lost 1"]), (30.0, ["lost 3", "gutted"]), (75.0, ["padded"])]
