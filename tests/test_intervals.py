"""Periods and gaps: hand-made cases, and brute force over random intervals."""

import datetime as dt
import random

import pytest

from tallyforge.operators.intervals import latest_rows, periods_and_gaps

D = dt.date
SHAPE = "k long, s date, e date, o boolean, kind string, from_at string"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SHAPE)
    return sorted(tuple(r) for r in periods_and_gaps(df, ["k"], "s", "e", "o", **kw).collect())


def test_overlap_nest_touch_gap(spark):
    rows = [(1, D(2020, 1, 1), D(2020, 6, 1), False), (1, D(2020, 2, 1), D(2020, 3, 1), False), (1, D(2020, 6, 1), D(2020, 7, 1), None), (1, D(2021, 1, 1), D(2021, 2, 1), False)]
    assert run(spark, rows) == [
        (1, "gap", D(2020, 7, 1), D(2021, 1, 1), False),
        (1, "period", D(2020, 1, 1), D(2020, 7, 1), False),
        (1, "period", D(2021, 1, 1), D(2021, 2, 1), False),
    ]


def test_open_runs_on(spark):
    rows = [(1, D(2020, 1, 1), D(2019, 1, 1), True), (1, D(2022, 1, 1), D(2022, 2, 1), False)]
    assert run(spark, rows) == [(1, "period", D(2020, 1, 1), None, True)]


def test_left_out(spark):
    rows = [(1, None, D(2020, 1, 1), True), (1, D(2020, 1, 1), None, None), (1, D(2020, 2, 1), D(2020, 1, 1), False)]
    assert run(spark, rows) == []


def test_empty_null_key_and_repeats(spark):
    assert run(spark, []) == []
    rows = [(None, D(2020, 1, 1), D(2020, 2, 1), False)] * 3
    assert run(spark, rows) == [(None, "period", D(2020, 1, 1), D(2020, 2, 1), False)]


def brute(rows):
    out = []
    for k in {r[0] for r in rows}:
        spans = sorted((s, e) for kk, s, e, _ in rows if kk == k and s and e and e >= s)
        merged = []
        for s, e in spans:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(k, "period", s, e, False) for s, e in merged] + [(k, "gap", a[1], b[0], False) for a, b in zip(merged, merged[1:])]
    return sorted(out)


@pytest.mark.parametrize("chunk", [None, "month", "year"])
def test_against_brute_force(spark, chunk):
    r = random.Random(5)
    rows = []
    for _ in range(600):
        s = D(2015, 1, 1) + dt.timedelta(days=r.randrange(3000))
        rows.append((r.choice([1, 1, 1, 2, 3]), s, s + dt.timedelta(days=r.randrange(-3, 40)), False))
    got = [(k, kind, a, b, o) for k, kind, a, b, o in run(spark, rows, chunk=chunk)]
    assert got == brute(rows)


def test_latest_row_wins_and_ties_are_stable(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 0, t, 5), (1, 0, t + dt.timedelta(1), 3), (1, 0, t + dt.timedelta(1), 4), (1, 1, None, 9)]
    df = spark.createDataFrame(rows, "a long, b long, at timestamp, v long")
    assert sorted(map(tuple, latest_rows(df, ["a", "b"], ["at"], ["v"]).collect())) == [(1, 0, 4), (1, 1, 9)]
