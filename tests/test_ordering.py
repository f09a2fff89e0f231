"""Places, carried values and greedy windows against plain loops, with ties, nulls, bursts and nothing."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewright.operators import ordering

START = datetime(2024, 1, 1)


def test_numbered_and_carried(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(20)]), i, rng.choice([None, None, i])) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int, v int").repartition(7)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [tuple(r)[:3] for r in ordering.numbered(df, ["a", "b"]).orderBy("pos").collect()] == order
    assert [r["pos"] for r in ordering.numbered(df, ["a", "b"]).orderBy("pos").collect()] == list(range(500))
    last, want = None, {}
    for a, b, v in order:
        last = v if v is not None else last
        want[b] = last
    assert {r["b"]: r["c"] for r in ordering.carried(df, ["a", "b"], F.col("v"), "c").collect()} == want


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_reached_by_doubling(spark, n):
    rng = random.Random(n)
    steps = {i: rng.randint(i + 1, min(i + 4, n)) for i in range(n - 1)}
    want, at = {0}, 0
    while at in steps:
        at = steps[at]
        want.add(at)
    assert {r["pos"] for r in ordering.reached(spark.createDataFrame(list(steps.items()), "pos long, to long"), 0).collect()} == want


def plain(rows, seconds):
    out, anchor = {}, None
    for ts, i in sorted((ts, i) for i, ts in rows if ts is not None):
        if anchor is None or ts > anchor[0] + timedelta(seconds=seconds):
            anchor = (ts, i)
        out[i] = (anchor[1], anchor[0])
    return out


@pytest.mark.parametrize("spread", [1, 30, 4000, 10**6])
def test_greedy_windows(spark, spread):
    rng = random.Random(spread)
    rows = [(i, None if i % 37 == 0 else START + timedelta(seconds=rng.randint(0, spread), microseconds=rng.choice([0, 0, 1]))) for i in range(400)]
    rows += [(1000 + k, START + timedelta(seconds=10**7 + 60 * k)) for k in range(5)]  # ends meet starts
    df = spark.createDataFrame(rows, "id long, ts timestamp").repartition(6)
    got = {r["id"]: (r["anchor"], r["anchor_ts"]) for r in ordering.greedy_windows(df, "id", "ts", 60).collect()}
    assert got == plain(rows, 60)


def test_greedy_windows_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "id long, ts timestamp")
    assert ordering.greedy_windows(df, "id", "ts", 60).collect() == [] and ordering.greedy_windows(df.filter("false"), "id", "ts", 60).columns == ["id", "ts", "anchor", "anchor_ts"]
