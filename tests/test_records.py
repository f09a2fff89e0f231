"""Small operations on records, with nulls, ties, odd names and nothing."""

import hashlib
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tracewright.operators import records

START = datetime(2024, 1, 1)


def test_bursts(spark):
    times = {"a": [0, 10, 20, 500, 505, 511], "b": [0, 100], None: [0, 0, 0]}
    rows = [(k, START + timedelta(seconds=t)) for k, ts in times.items() for t in ts] + [("b", None)] * 5
    df = spark.createDataFrame(rows, "k string, ts timestamp").repartition(3)
    got = {r["k"]: (r["first"], r["n"]) for r in records.bursts(df, "k", "ts", 3, 20).collect()}
    assert got == {"a": (START, 2), None: (START, 1)}
    assert {r["k"]: r["n"] for r in records.bursts(df, "k", "ts", 1, 0).collect()} == {"a": 6, "b": 2, None: 3}
    assert records.bursts(df.filter("false"), "k", "ts", 3, 20).isEmpty()


def test_prefixes_and_terms(spark):
    df = spark.createDataFrame([("a_b:1",), ("axb:2",), ("a%b",), (None,), ("a\\b",)], "k string")
    find = lambda p: {r["k"] for r in records.with_prefix(df, "k", p).collect()}
    assert find("a_b:*") == {"a_b:1"} and find("a*b") == {"a%b", "a\\b"} and find("a%*") == {"a%b"} and find("a\\*") == {"a\\b"} and find("*") == {"a_b:1", "axb:2", "a%b", "a\\b"}
    texts = spark.createDataFrame([(i, "Wash" if i % 2 else None, "trade" if i % 3 == 0 else "WASHED") for i in range(20)], "id int, a string, b string")
    hits = [i for i in range(20) if i % 2 or i % 3]
    assert [r["id"] for r in records.term_search(texts, "wAsh", ["a", "b"], ["id"], 3, 5).collect()] == hits[3:8]
    assert records.term_search(texts, "wash", ["a", "b"], ["id"]).count() == len(hits)


def test_load_counts_what_it_writes(spark, tmp_path):
    known = spark.createDataFrame([(1, "old", None), (2, "old", 5)], "id long, a string, b long")
    rows = spark.createDataFrame([(2, "new", None), (3, None, None), (None, "lost", 1)], "id long, a string, b long")
    stored, counts = records.merged_with_statistics(known, rows, "id", f"{tmp_path}/t")
    assert sorted(map(tuple, stored.collect())) == [(1, "old", None), (2, "new", None), (3, None, None)]
    assert counts == {"records": 2, "created": 1, "merged": 1, "properties": 1}
    assert records.merged_with_statistics(known.filter("false"), rows.filter("false"), "id", f"{tmp_path}/u")[1] == {"records": 0, "created": 0, "merged": 0, "properties": 0}


def test_labels_kinds_queues_costs(spark):
    df = spark.createDataFrame([("x", "k", 1.0), ("y", None, None), (None, "m", 2.0)], "id string, kind string, u double")
    assert [r["scenario"] for r in records.labelled(df, "id", {"one": ["x"], "two": ["x", "y"], "none": []}).collect()] == ["one", "two", None]
    assert [r["id"] for r in records.without_kinds(df, "kind", ["k"]).collect()] == ["y", None]
    assert [r["cost"] for r in records.costs(df, "kind", F.col("u"), {"k": 0.5}).collect()] == [0.5, 0.0, 0.0] and records.costs(df, "kind", F.col("u"), {}).filter("cost <> 0").isEmpty()
    got = {r["kind"]: (r["waiting"], r["running"], r["workers"]) for r in records.queues(df, "kind", "id", F.col("u") > 1.5).collect()}
    assert got == {"k": (1, 0, 0), None: (1, 0, 0), "m": (0, 1, 0)}


def test_digests_limits_and_drawings(spark):
    df = spark.createDataFrame([(1, None, "ü\"")], "b int, a string, c string")
    assert df.select(records.digest(["c", "b", "a"]).alias("d")).first()["d"] == hashlib.md5('{"a":null,"b":1,"c":"ü\\""}'.encode()).hexdigest()
    assert records.limited(spark.range(3000), ["id"]).count() == records.SAFE_LIMIT and records.limited(spark.range(9), ["id"], 2).count() == 2
    colours = spark.createDataFrame([(0.71,), (0.7,), (0.4,), (None,)], "p double").select(records.band_colour(F.col("p")).alias("c"))
    assert [r["c"] for r in colours.collect()] == ["red", "orange", "green", "grey"]
    assert records.drawn_edges(spark.createDataFrame([(1, None, 2)], "src int, dst int, n int"), "n").collect()[0].asDict() == {"from": "1", "to": None, "label": "2", "arrows": "to"}
