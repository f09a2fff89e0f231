"""A graph network of two layers over sampled neighbours, trained by Spark: joins make each node's block, tasks sum gradients, the driver steps.

    h(v) = relu(W1' [x(v), mean x of v's sample] + b1)          p(v) = sigmoid(w2' [h(v), mean h of v's sample] + b2)

Blocks are built once: a node's own input and those of its sampled neighbours, at most `sample` of them, so a hub is a row like any
other. A step sends the weights out with the tasks; gradients come back summed as whole numbers (units of 2**-30), one row for each
weight, so networks learned under another partitioning differ by no more than this rounding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tracewright.lineage import written

UNIT = 2.0**30


@dataclass
class Network:
    """inputs: features of a node and means of its sample. Weights in one vector: W1, b1, w2 (own, sample), b2."""

    inputs: int
    hidden: int
    weights: np.ndarray
    near: bool = True

    @staticmethod
    def start(inputs: int, hidden: int, seed: int = 5, near: bool = True) -> Network:
        rng = np.random.default_rng(seed)
        w1, w2 = rng.normal(size=inputs * hidden) / np.sqrt(inputs), rng.normal(size=2 * hidden) / np.sqrt(2 * hidden)
        return Network(inputs, hidden, np.concatenate([w1, np.zeros(hidden), w2, [0.0]]), near)

    def parts(self, weights: np.ndarray) -> list[np.ndarray]:
        i, h = self.inputs, self.hidden
        w1, b1, w2, b2 = np.split(weights, [i * h, i * h + h, i * h + 3 * h])
        return [w1.reshape(i, h), b1, w2, b2]

    def _forward(self, own: np.ndarray, around: np.ndarray, rows: np.ndarray) -> tuple:
        """own: nodes x inputs; around: all sampled neighbours x inputs; rows: the node of each neighbour, ascending."""
        w1, b1, w2, b2 = self.parts(self.weights)
        if not self.near:
            own, around, rows = own * (np.arange(self.inputs) < self.inputs // 2), around[:0], rows[:0]
        a, b = own @ w1 + b1, w1.T @ around.T + b1[:, None]  # b has a row for each hidden unit, along which neighbours are summed
        n = np.bincount(rows, minlength=len(own))
        counts, mean, starts = np.maximum(n, 1)[:, None], np.zeros((len(own), self.hidden)), np.cumsum(n) - n
        if len(rows):
            mean[n > 0] = np.add.reduceat(np.maximum(b, 0), starts[n > 0], axis=1).T  # a node's neighbours stand together
        mean /= counts
        p = 1 / (1 + np.exp(-(np.maximum(a, 0) @ w2[: self.hidden] + mean @ w2[self.hidden :] + b2)))
        return own, around, n, a, b, counts, mean, p

    def probability(self, own: np.ndarray, around: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self._forward(own, around, rows)[-1]

    def gradient(self, own: np.ndarray, around: np.ndarray, rows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum of the weighted logistic losses, and its gradient by the weights."""
        own, around, n, a, b, counts, mean, p = self._forward(own, around, rows)
        w2, h = self.parts(self.weights)[2], self.hidden
        loss = float(-(weight * np.log(np.where(y == 1, p, 1 - p) + 1e-300)).sum())
        d = weight * (p - y)
        da = d[:, None] * w2[:h] * (a > 0)
        db = np.repeat(np.ascontiguousarray((d[:, None] * w2[h:] / counts).T), n, axis=1)
        db *= b > 0
        return loss, np.concatenate([(own.T @ da + (db @ around).T).ravel(), da.sum(axis=0) + db.sum(axis=1), d @ np.maximum(a, 0), d @ mean, [d.sum()]])


def blocks(nodes: DataFrame, edges: DataFrame, features: list[str], sample: int = 16) -> DataFrame:
    """(node, own, around), in the shared folder. nodes: node (unique) and features; null features are 0.

    own: features and the mean of the sample's features; around: the same of each sampled neighbour, one after the other. The sample is
    those neighbours (either direction, no loops, each once) with the smallest hashes of both names. Edges to nodes that aren't there go.
    """
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    known = written(nodes.select("node", x.alias("x")))
    pairs = edges.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst")
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = both.join(known.select(F.col("node").alias("dst")), "dst", "left_semi")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.xxhash64("src", "dst"), "dst"))
    near = written(both.withColumn("_r", rank).filter(F.col("_r") <= sample).select("src", "dst"))  # Spark drops the rest of a hub before the shuffle
    d = len(features)
    met = near.join(known.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"))
    means = met.agg(*[F.round(F.sum(F.get("x", F.lit(k)).cast("decimal(38,12)")) / F.count("*"), 12).cast("double").alias(f"_m{k}") for k in range(d)])
    own = known.join(means, "node", "left").select("node", F.concat("x", F.array(*[F.coalesce(F.col(f"_m{k}"), F.lit(0.0)) for k in range(d)])).alias("own"))
    own = written(own)
    around = near.join(own.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("dst", "own"))), lambda s: s["own"])).alias("around"))
    return written(own.join(around, "node", "left").select("node", "own", F.coalesce("around", F.array().cast("array<double>")).alias("around")))


def _matrices(part: pd.DataFrame, inputs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = np.array(part["own"].tolist(), np.float64).reshape(-1, inputs)
    counts = [len(a) // inputs for a in part["around"]]
    around = np.concatenate([np.zeros(0), *part["around"]]).reshape(-1, inputs)
    return own, around, np.repeat(np.arange(len(own)), counts)


def _arrays(batch: pa.RecordBatch, inputs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _matrices(), without an object for each row. A batch without around has no neighbours."""
    own = batch.column("own").flatten().to_numpy(zero_copy_only=False).reshape(-1, inputs)
    if "around" not in batch.schema.names:
        return own, np.zeros((0, inputs)), np.zeros(0, np.int64)
    around = batch.column("around")
    counts = pc.list_value_length(around).to_numpy(zero_copy_only=False) // inputs
    return own, around.flatten().to_numpy(zero_copy_only=False).reshape(-1, inputs), np.repeat(np.arange(len(own)), counts)


def fit(rows: DataFrame, inputs: int, hidden: int = 8, steps: int = 40, rate: float = 0.05, decay: float = 1e-4, near: bool = True, seed: int = 5) -> tuple[Network, list[float]]:
    """rows: own, around, _y (0 or 1) and _w, in the shared folder. The network, and the mean loss before each step (Adam over all rows).

    near False: the same network over a node's own features alone; around isn't read. Without rows, the network that it starts with.
    """
    net = Network.start(inputs, hidden, seed, near)
    total = rows.agg(F.sum("_w").alias("w")).first()["w"]
    one, two, losses = np.zeros_like(net.weights), np.zeros_like(net.weights), []
    for step in range(1, steps + 1 if total else 1):
        now = net

        def add_up(parts: Iterator[pa.RecordBatch], now: Network = now) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(len(now.weights) + 1, np.int64)
            for whole in parts:
                found = np.zeros(len(sums))
                for at in range(0, whole.num_rows, 500):  # few enough for a core's cache
                    part = whole.slice(at, 500)
                    loss, g = now.gradient(*_arrays(part, inputs), part.column("_y").to_numpy(), part.column("_w").to_numpy())
                    found += np.append(g, loss)
                sums += np.rint(found * UNIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], names=["k", "g"])

        summed = rows.select(*(["own", "around"] if near else ["own"]), "_y", "_w").mapInArrow(add_up, "k int, g long").groupBy("k").agg(F.sum("g").alias("g")).collect()  # one row for each weight
        found = np.zeros(len(net.weights) + 1)
        for r in summed:
            found[r["k"]] = r["g"] / UNIT / total
        g = found[:-1] + decay * net.weights
        losses.append(float(found[-1]))
        one, two = 0.9 * one + 0.1 * g, 0.999 * two + 0.001 * g * g
        net = Network(inputs, hidden, net.weights - rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8), near)
    return net, losses


def predicted(made: DataFrame, nets: dict[str, Network]) -> DataFrame:
    """(node, a probability for each network by its name) of all blocks."""
    inputs = next(iter(nets.values())).inputs
    kind = made.schema["node"].dataType.simpleString()

    def predict(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            matrices = _matrices(part, inputs)
            yield pd.DataFrame({"node": part["node"], **{name: net.probability(*matrices) for name, net in nets.items()}})

    return made.select("node", "own", "around").mapInPandas(predict, f"node {kind}, {', '.join(f'`{n}` double' for n in nets)}")


def ranked(scores: DataFrame, column: str, threshold: float = 0.5) -> DataFrame:
    """scores with flagged (at least the threshold) and band: high from halfway between the threshold and 1, medium from the threshold, else low."""
    p = F.col(column)
    return scores.withColumns({"flagged": p >= threshold, "band": F.when(p >= (1 + threshold) / 2, "high").when(p >= threshold, "medium").otherwise("low")})
