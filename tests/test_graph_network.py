"""The graph network: gradients, blocks by hand, the same under any partitioning, what neighbours add, nothing."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright import catalog_learning
from tracewright.operators import graph_network as gn


@pytest.mark.parametrize("near", [True, False])
def test_gradient_against_differences(near):
    rng = np.random.default_rng(2)
    own, around, rows = rng.normal(size=(6, 4)), rng.normal(size=(9, 4)), np.array([0, 0, 0, 2, 2, 3, 5, 5, 5])
    y, w = np.array([0, 1, 1, 0, 1, 0]), rng.random(6) + 0.5
    net = gn.Network.start(4, 3, 1, near)
    net.weights = net.weights + 0.1
    _, g = net.gradient(own, around, rows, y, w)
    for k in range(len(net.weights)):
        e = np.zeros_like(net.weights)
        e[k] = 1e-6
        up, down = (gn.Network(4, 3, net.weights + s * e, near).gradient(own, around, rows, y, w)[0] for s in (1, -1))
        assert abs((up - down) / 2e-6 - g[k]) < 1e-5


def test_blocks_by_hand(spark):
    nodes = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, 4.0), ("c", 5.0, 6.0), ("d", 7.0, 8.0)], "node string, p double, q double")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("c", "c"), ("x", "a"), (None, "b"), ("a", None)], "src string, dst string")
    got = {r["node"]: (list(r["own"]), list(r["around"])) for r in gn.blocks(nodes, edges, ["p", "q"]).collect()}
    own = {"a": [1.0, 0.0, 3.5, 5.0], "b": [2.0, 4.0, 1.0, 0.0], "c": [5.0, 6.0, 1.0, 0.0], "d": [7.0, 8.0, 0.0, 0.0]}
    assert got == {"a": (own["a"], own["b"] + own["c"]), "b": (own["b"], own["a"]), "c": (own["c"], own["a"]), "d": (own["d"], [])}
    one = {r["node"]: len(r["around"]) // 4 for r in gn.blocks(nodes, edges, ["p", "q"], 1).collect()}
    assert one == {"a": 1, "b": 1, "c": 1, "d": 0}


def planted(spark):
    """The label is the sign of the neighbours' mean."""
    rng = np.random.default_rng(3)
    x, edges = rng.normal(size=300), {(int(a), int(b)) for a, b in rng.integers(0, 300, (900, 2)) if a != b}
    near = {i: [x[b] for a, b in edges if a == i] + [x[a] for a, b in edges if b == i and (i, a) not in edges] for i in range(300)}
    nodes = spark.createDataFrame([(i, float(x[i]), int(np.mean(near[i] or [0.0]) > 0)) for i in range(300)], "node long, f double, y int")
    return nodes, spark.createDataFrame(sorted(edges), "src long, dst long")


def test_neighbours_help_and_partitions_do_not_matter(spark):
    nodes, edges = planted(spark)
    learn = gn.blocks(nodes, edges, ["f"]).join(nodes.select("node", F.col("y").cast("double").alias("_y"), F.lit(1.0).alias("_w")), "node")
    net, losses = gn.fit(learn.repartition(3).cache(), 2, 4, 25, 0.1)
    again, _ = gn.fit(learn.repartition(1), 2, 4, 3, 0.1)
    first, _ = gn.fit(learn.repartition(5), 2, 4, 3, 0.1)
    assert np.allclose(again.weights, first.weights, atol=1e-7) and losses[-1] < 0.6 * losses[0]
    alone, alone_losses = gn.fit(learn.repartition(2).cache(), 2, 4, 25, 0.1, near=False)
    assert alone_losses[-1] > 0.6
    scores = gn.predicted(gn.blocks(nodes, edges, ["f"]), {"net": net, "alone": alone}).join(nodes, "node").toPandas()
    assert np.mean((scores["net"] >= 0.5) == (scores["y"] == 1)) > 0.85
    bands = gn.ranked(spark.createDataFrame([(0.4,), (0.5,), (0.75,), (None,)], "p double"), "p").collect()
    assert [(r["flagged"], r["band"]) for r in bands] == [(False, "low"), (True, "medium"), (True, "high"), (None, "low")]


def test_nothing(spark):
    nodes, edges = planted(spark)
    none = gn.blocks(nodes.filter("false"), edges, ["f"])
    assert none.isEmpty()
    net, losses = gn.fit(none.withColumns({"_y": F.lit(1.0), "_w": F.lit(1.0)}), 2, 4, 3)
    assert losses == [] and gn.predicted(none, {"net": net}).isEmpty() and isinstance(gn._matrices(pd.DataFrame({"own": [], "around": []}), 2)[0], np.ndarray)


def test_held_out_accounts(spark):
    got = {r["model"]: r for r in catalog_learning.graph_network_figures(spark, "/root/testdata/sf0.01").collect()}
    print({k: v["auc"] for k, v in got.items()})
    assert got["network"]["auc"] > got["alone"]["auc"] + 0.1 and got["network"]["auc"] > 0.7


def test_without_neighbours_they_are_not_read(spark):
    rows = spark.createDataFrame([([float(i), 0.0], float(i % 2), 1.0) for i in range(20)], "own array<double>, _y double, _w double")
    spoilt = rows.withColumn("around", F.raise_error(F.lit("read")).cast("array<double>"))
    assert len(gn.fit(spoilt, 2, 3, 2, near=False)[1]) == 2


def test_arrays_of_batches_as_matrices_of_rows():
    part = pd.DataFrame({"own": [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], "around": [[1.0, 2.0, 3.0, 4.0], [], [5.0, 6.0]]})
    batch = pa.RecordBatch.from_pandas(part)
    for a, b in ((batch, part), (batch.slice(1, 2), part.iloc[1:])):
        assert all(np.array_equal(x, y) for x, y in zip(gn._arrays(a, 2), gn._matrices(b, 2), strict=True))
