"""Vectors of elements: neighbours nearer than others, the same under any partitioning, means by hand, odd texts and nothing."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from tracewright.operators import element_vectors as ev


def signs(text):
    return [1_000_000 if c >= "8" else -1_000_000 for c in hashlib.md5(text.encode()).hexdigest()]


def rounded(x):
    return int(math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1))


def communities(spark, seed=1):
    rng = random.Random(seed)
    edges = [(f"{g}-{rng.randrange(20)}", f"{g}-{rng.randrange(20)}") for g in range(5) for _ in range(80)]
    return edges + [(f"{rng.randrange(5)}-{rng.randrange(20)}", f"{rng.randrange(5)}-{rng.randrange(20)}") for _ in range(12)] + [("0-1", "0-1"), (None, "0-2"), ("0-3", "0-4"), ("0-3", "0-4")]


def test_neighbourhoods_by_hand_and_under_any_partitioning(spark):
    edges = communities(spark)
    df = spark.createDataFrame(edges, "src string, dst string")
    near = {}
    for a, b in edges:
        if a and b and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    v0 = {n: signs(n) for n in near}
    step = lambda v: {n: [rounded(sum(v[m][k] for m in near[n]) / len(near[n])) for k in range(32)] for n in near}
    v1 = step(v0)
    v2 = step(v1)
    want = {n: [a + b for a, b in zip(v1[n], v2[n], strict=True)] for n in near}
    for parts in (1, 7):
        assert {r["node"]: list(r["v"]) for r in ev.neighbourhoods(df.repartition(parts)).collect()} == want


def test_neighbours_are_nearer_than_random_pairs(spark):
    vectors = {r["node"]: np.array(r["v"], float) for r in ev.neighbourhoods(spark.createDataFrame(communities(spark, 2), "src string, dst string")).collect()}
    cosine = lambda a, b: a @ b / math.sqrt((a @ a) * (b @ b))
    names = sorted(vectors)
    inside = [cosine(vectors[a], vectors[b]) for a in names for b in names if a < b and a[0] == b[0]]
    across = [cosine(vectors[a], vectors[b]) for a in names for b in names if a < b and a[0] != b[0]]
    assert np.mean(inside) > np.mean(across) + 0.4


def test_texts_means_and_names(spark):
    items = spark.createDataFrame([(1, "Red fox, red FOX"), (2, "red"), (3, ""), (4, None), (5, "x" * 500), (None, "red")], "id long, text string")
    got = {r["id"]: list(r["v"]) for r in ev.text_vectors(items, "id", "text").collect()}
    red, fox = signs("red"), signs("fox")
    assert got[1] == [rounded((a + b) / 2) for a, b in zip(red, fox, strict=True)] and got[2] == got[None] == red and got[3] == got[4] == [0] * 32
    vectors = ev.text_vectors(items, "id", "text").withColumnRenamed("id", "node")
    members = spark.createDataFrame([("p", 1), ("p", 2), ("p", 2), ("q", 9)], "key string, node long")
    assert {r["key"]: list(r["v"]) for r in ev.mean_of(members, "key", vectors).collect()} == {"p": [rounded((a + b) / 2) for a, b in zip(got[1], got[2], strict=True)]}
    named = {r["id"]: (r["text"], r["strategy"]) for r in ev.elements("node", "own", vectors.withColumnRenamed("node", "id"), "id", items.filter("id IS NOT NULL")).collect()}
    assert named["node_5_own"] == ("x" * 200, "own") and named["node_4_own"] == (None, "own")
    row = ev.text_vectors(items, "id", "text").filter("id = 2").select(ev.cosine(F.col("v"), F.col("v")).alias("c")).first()
    assert abs(row["c"] - 1) < 1e-12


def test_nothing(spark):
    assert ev.neighbourhoods(spark.createDataFrame([("a", "a")], "src string, dst string")).isEmpty()
    assert ev.text_vectors(spark.createDataFrame([], "id long, text string"), "id", "text").isEmpty()


def test_blocks_of_pairs_with_loops_both_ways_and_hubs(spark):
    edges = [*communities(spark, 3), *[("hub", f"n{k}") for k in range(60)], *[(f"n{k}", "hub") for k in range(0, 60, 7)], ("n1", "n1"), ("lone", "lone")]
    df = spark.createDataFrame(edges, "src string, dst string")
    vectors = ev.neighbourhoods(df).persist()
    kept = {(a, b) for a, b in edges if a is not None and b is not None}
    v = {r["node"]: list(r["v"]) for r in vectors.collect()}
    mean = lambda names: [rounded(sum(v[n][k] for n in names) / len(names)) for k in range(32)]
    near = {n: {n} | {b for a, b in kept if a == n} | {a for a, b in kept if b == n} for n in v}
    for n in (1, 3, 9):
        cells = ev.blocks(df, n)
        assert {r["node"]: list(r["v"]) for r in ev.neighbourhoods(None, cells=cells).collect()} == v
        rows = ev.edge_means(cells, vectors).collect()
        got = {r["key"]: list(r["v"]) for r in rows}
        assert len(rows) == len(got) and got == {f"{a}>{b}": mean({a, b}) for a, b in kept if a in v}
        assert {r["key"]: list(r["v"]) for r in ev.ball_means(cells, vectors).collect()} == {n: mean(near[n]) for n in v}


def test_vectors_do_not_go_along_edges(spark):
    from test_registers import shuffled

    from tracewright import catalog

    before = shuffled(spark)
    assert catalog.QUERIES["v13_edge_and_subgraph_vectors"](spark, "/root/testdata/sf0.01").count() > 50_000
    assert shuffled(spark) - before < 6_000_000  # 16 MB with vectors along edges
