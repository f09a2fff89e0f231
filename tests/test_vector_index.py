"""The inverted file against exact search: recall, rows looked at, large cells, odd vectors, nothing."""

import numpy as np
from pyspark.sql import functions as F

from tracewright import catalog_learning
from tracewright.operators import vector_index


def exact(rows, asked, k):
    ids = np.array([i for i, v in rows])
    m = np.array([v for _, v in rows], np.float64)
    m /= np.sqrt((m**2).sum(axis=1))[:, None]
    out = {}
    for qid, v in asked:
        sim = np.round(m @ (np.array(v) / np.linalg.norm(v)), 6)
        out[qid] = [(int(ids[t]), float(sim[t])) for t in np.lexsort((ids, -sim))[:k]]
    return out


def test_recall_on_all_embeddings(spark):
    d = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = catalog_learning.inverted_file(spark, d).collect()
    want = exact(rows, [(i, v) for i, v in rows if i % 20 == 0], 10)
    hits = sum((r["id"], r["similarity"]) in want[r["qid"]] for r in got)
    assert len(got) == 10 * len(want) and hits / (10 * len(want)) >= 0.9
    share = np.mean([r["looked"] for r in got]) / len(rows)
    print("recall", hits / (10 * len(want)), "share of rows looked at", share)
    assert share < 0.95


def test_clusters_need_few_rows_and_hot_cells_are_split(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 5
    rows = [(i, (centres[i % 40] + rng.normal(size=16)).tolist()) for i in range(3000)] + [(5000 + i, [1.0] * 16) for i in range(1500)]
    items = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    index = vector_index.learn(items)
    coded = vector_index.indexed(items, index, block=100)
    assert coded.groupBy("cell", "block").count().agg(F.max("count")).first()[0] < 200 and coded.count() == len(rows)
    asked = rows[:60] + rows[-1:]
    got = vector_index.search(items, coded, index, spark.createDataFrame(asked, "qid long, qv array<double>"), 5).collect()
    want = exact(rows, asked, 5)
    assert sum((r["id"], r["similarity"]) in want[r["qid"]] for r in got) / (5 * len(asked)) >= 0.9
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["qid"] == rows[-1][0]] == [5000, 5001, 5002, 5003, 5004]
    assert np.mean([r["looked"] for r in got if r["qid"] < 60]) < 0.25 * len(rows)


def test_same_index_under_any_partitioning(spark):
    rng = np.random.default_rng(2)
    items = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(500)], "id long, v array<double>")
    a, b = vector_index.learn(items.repartition(7)), vector_index.learn(items.coalesce(1))
    assert (a.cells == b.cells).all() and (a.codebooks == b.codebooks).all() and a.probes == b.probes


def test_odd_vectors_and_nothing(spark):
    schema = "id long, v array<double>"
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [1.0, 2.0, 3.0]), (7, [3.0, 4.0]), (8, [4.0, 3.0]), (9, [3.0, 4.0])]
    items = spark.createDataFrame(rows, schema)
    index = vector_index.learn(items)
    coded = vector_index.indexed(items, index)
    assert sorted(r["id"] for r in coded.collect()) == [7, 8, 9]
    got = vector_index.search(items, coded, index, items.select(F.col("id").alias("qid"), F.col("v").alias("qv")), 2).collect()
    assert sorted((r["qid"], r["rank"], r["id"], r["similarity"]) for r in got) == [(7, 1, 7, 1.0), (7, 2, 9, 1.0), (8, 1, 8, 1.0), (8, 2, 7, 0.96), (9, 1, 7, 1.0), (9, 2, 9, 1.0)]
    assert vector_index.learn(items.filter("id < 4")) is None and vector_index.learn(items.filter("false")) is None
