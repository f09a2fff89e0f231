"""Vectors for the elements of a graph and for texts, without a model: hashed words, and random signs of nodes averaged along edges.

Everything is whole numbers in units of 1 / UNIT and Spark expressions, so that vectors are the same under any partitioning. A vector's
SIZE numbers are columns while they are summed, and an array in the end.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tracewright.lineage import written
from tracewright.operators.searches import Lists
from tracewright.views import parts

#: Numbers of a vector: one for each hexadecimal digit of an md5. Units of 1.
SIZE, UNIT = 32, 1_000_000
NAMES = [f"_v{k}" for k in range(SIZE)]
#: Characters of the text that an element shows.
SHOWN = 200


def signs(c: Column) -> list[Column]:
    """UNIT or -UNIT for each number: the digits of the md5 from 8 on are positive."""
    digits = F.md5(c.cast("string").cast("binary"))
    return [F.when(F.substring(digits, k + 1, 1) >= "8", UNIT).otherwise(-UNIT).cast("long").alias(NAMES[k]) for k in range(SIZE)]


def array_of(prefix: str = "") -> Column:
    return F.array(*[F.col(prefix + n) for n in NAMES])


def text_vectors(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, v): the mean of the signs of a text's distinct words, in units; of texts without words, or null, zeros.

    Words are runs of letters and digits in lower case, of whole texts. Rows of one id count as one text.
    """
    words = F.explode_outer(F.array_distinct(F.filter(F.split(F.lower(text_col), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)))
    rows = items.select(id_col, words.alias("_w")).distinct()
    n = F.count("_w")
    mean = [F.when(n > 0, F.round(F.sum(s) / n)).otherwise(0).cast("long").alias(name) for s, name in zip([F.when(F.col("_w").isNotNull(), x) for x in signs(F.col("_w"))], NAMES, strict=True)]
    return rows.groupBy(id_col).agg(*mean).select(id_col, array_of().alias("v"))


def blocks(edges: DataFrame, n: int | None = None) -> DataFrame:
    """(block, nodes, pairs): the distinct pairs of edges (src, dst) in about n ranges of their smaller end, so that an end's pairs are mostly in one block.

    nodes: the ends of a block's pairs, each once; pairs: packed places in nodes of the smaller end and the other one, and whether an edge goes
    from the smaller (1), to it (2), or both (3). An end with more pairs than a block is in several blocks. n: by default a block for each
    1,000,000 edges, as many as cores at least.
    """
    here, there = F.least("src", "dst"), F.greatest("src", "dst")
    ways = edges.filter("src IS NOT NULL AND dst IS NOT NULL").select(here.cast("string").alias("a"), there.cast("string").alias("b"), (F.col("src") <= F.col("dst")).alias("_to"))
    once = ways.repartitionByRange(n or parts(edges), "a", "b").groupBy("a", "b").agg(F.max(F.when(F.col("_to"), 1).otherwise(0)).alias("_1"), F.max(F.when(F.col("_to"), 0).otherwise(2)).alias("_2"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            ends = pa.chunked_array([*table["a"].chunks, *table["b"].chunks]).combine_chunks().dictionary_encode()
            at = ends.indices.to_numpy().astype(np.int32).reshape(2, -1)
            order = np.lexsort((at[1], at[0]))
            flat = np.stack([*np.diff(at[:, order], axis=1, prepend=0), table["way"].to_numpy()[order]]).astype(np.int32)
            data = zlib.compress(np.ascontiguousarray(flat.view(np.uint8).reshape(3, -1, 4).transpose(0, 2, 1)).tobytes(), 1)
            yield pa.record_batch({"block": pa.array([table["block"][0].as_py()], pa.int32()), "nodes": pa.array([ends.dictionary.to_pylist()], pa.list_(pa.string())), "pairs": pa.array([data], pa.binary())})

    return written(once.select("a", "b", (F.col("_1") + F.col("_2")).cast("int").alias("way"), F.spark_partition_id().alias("block")).mapInArrow(pack, "block int, nodes array<string>, pairs binary"))


def _pairs(data: bytes) -> np.ndarray:
    """Places of the smaller end, of the other, and the way, of packed pairs."""
    flat = np.frombuffer(zlib.decompress(data), np.uint8).reshape(3, 4, -1).transpose(0, 2, 1).copy().view(np.int32)[:, :, 0]
    return np.stack([*flat[:2].cumsum(axis=1, dtype=np.int32), flat[2]])


def _in_blocks(cells: DataFrame, vectors: DataFrame | None, step: Callable[..., pa.Table], schema: str) -> DataFrame:
    """What step gives of each block's nodes, pairs and vectors (a row a node); pairs without a vector at both ends are left out. vectors: node, v; without, the signs of names.

    A vector goes once to each block that has its node, and none goes along a pair.
    """
    places = cells.select(F.col("block").alias("cell"), F.posexplode("nodes").alias("at", "node"))
    sent = places.select("cell", "at", F.array(*[c.cast("int") for c in signs(F.col("node"))]).alias("v")) if vectors is None else places.join(vectors.select("node", "v"), "node").select("cell", "at", F.col("v").cast("array<int>").alias("v"))

    def run(cell: pa.Table, sent: pa.Table) -> pa.Table:
        nodes = cell["nodes"].combine_chunks().flatten()
        v, has = np.zeros((len(nodes), SIZE), np.int64), np.zeros(len(nodes), bool)
        for batch in sent.to_batches():
            at = batch["at"].to_numpy()
            v[at], has[at] = batch["v"].flatten().to_numpy().reshape(-1, SIZE), True
        pairs = _pairs(cell["pairs"][0].as_py())
        return step(nodes, pairs[:, has[pairs[0]] & has[pairs[1]]], v)

    return cells.groupBy("block").cogroup(sent.groupBy("cell")).applyInArrow(run, schema)


def neighbour_sums(cells: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """(node, n, NAMES): of each node that has any, the number of its neighbours and the sum of their vectors; no loops."""

    def step(nodes: pa.Array, pairs: np.ndarray, v: np.ndarray) -> pa.Table:
        a, b, _ = pairs[:, pairs[0] != pairs[1]]
        near = Lists(np.concatenate([a, b]), np.concatenate([b, a]), len(nodes))
        sums = np.zeros_like(v)
        for some, got in near.gathered(np.ones(len(nodes), bool), v, np.add):
            sums[some] = got
        has = np.flatnonzero(near.length)
        return pa.table({"node": nodes.take(pa.array(has)), "n": near.length[has].astype(np.int64), **{name: sums[has, k] for k, name in enumerate(NAMES)}})

    found = _in_blocks(cells, vectors, step, ", ".join(["node string, n long", *[f"{name} long" for name in NAMES]]))
    return found.groupBy("node").agg(F.sum("n").alias("n"), *[F.sum(name).alias(name) for name in NAMES])


def neighbourhoods(edges: DataFrame, rounds: int = 2, cells: DataFrame | None = None) -> DataFrame:
    """(node, v): the sum over the rounds of a node's vector, each round the mean of its distinct neighbours' (either direction, no loops).

    Nodes start with the signs of their names. Vectors and sums of neighbours go to and from blocks of pairs, not along pairs; cells are
    those blocks where they are there already.
    """
    cells = blocks(edges) if cells is None else cells
    now, found = None, []
    for _ in range(rounds):
        mean = F.array(*[F.round(F.col(name) / F.col("n")).cast("int") for name in NAMES]).alias("v")
        now = written(neighbour_sums(cells, now).select("node", mean))
        found.append(now)
    total = found[0]
    for other in found[1:]:
        total = total.join(other.withColumnRenamed("v", "_w"), "node").select("node", F.zip_with("v", "_w", lambda x, y: x + y).alias("v"))
    return total.select("node", F.col("v").cast("array<long>").alias("v"))


def edge_means(cells: DataFrame, vectors: DataFrame) -> DataFrame:
    """(key, v): of each distinct edge, key src>dst, the mean vector of its ends, where both have one."""

    def step(nodes: pa.Array, pairs: np.ndarray, v: np.ndarray) -> pa.Table:
        found, schema = [], pa.schema([("key", pa.string()), ("v", pa.list_(pa.int32()))])
        for bit, (src, dst) in ((1, (0, 1)), (2, (1, 0))):
            some = pairs[:, pairs[2] & bit > 0]
            for at in range(0, some.shape[1], 16_384):
                ends = some[[src, dst], at : at + 16_384]
                total = v[ends[0]] + v[ends[1]]
                mean = (np.sign(total) * ((np.abs(total) + 1) // 2)).astype(np.int32)  # halves away from zero
                key = pc.binary_join_element_wise(nodes.take(pa.array(ends[0])), nodes.take(pa.array(ends[1])), ">")
                found.append(pa.record_batch([key, pa.ListArray.from_arrays(pa.array(np.arange(0, mean.size + 1, SIZE, dtype=np.int32)), pa.array(mean.ravel()))], schema=schema))
        return pa.Table.from_batches(found, schema)

    return _in_blocks(cells, vectors, step, "key string, v array<int>")


def ball_means(cells: DataFrame, vectors: DataFrame) -> DataFrame:
    """(key, v): of each node the mean vector of itself and its distinct neighbours."""
    own = vectors.select("node", *[F.get("v", F.lit(k)).alias(f"_o{k}") for k in range(SIZE)])
    mean = [F.round((F.col(name) + F.col(f"_o{k}")) / (F.col("n") + 1)).cast("int") for k, name in enumerate(NAMES)]
    return neighbour_sums(cells, vectors).join(own, "node").select(F.col("node").alias("key"), F.array(*mean).alias("v"))


def mean_of(members: DataFrame, key: str, vectors: DataFrame, node: str = "node") -> DataFrame:
    """(key, v): the mean vector of each group's members (key, node), each once; for edges their ends, for paths and subgraphs their nodes."""
    wide = vectors.select(F.col(node).alias("_n"), *[F.get("v", F.lit(k)).alias(NAMES[k]) for k in range(SIZE)])
    joined = members.select(key, F.col(node).alias("_n")).distinct().join(wide, "_n")
    return joined.groupBy(key).agg(*[F.round(F.sum(n) / F.count("*")).cast("long").alias(n) for n in NAMES]).select(key, array_of().alias("v"))


def elements(kind: str, strategy: str, vectors: DataFrame, id_col: str, texts: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """(id, kind, strategy, text, v): id is kind_id_strategy, text the first SHOWN characters that describe the element."""
    named = F.concat_ws("_", F.lit(kind), F.col(id_col).cast("string"), F.lit(strategy)).alias("id")
    rows = vectors.withColumn("_text", F.lit(None).cast("string")) if texts is None else vectors.join(texts.select(id_col, F.substring(F.col(text_col), 1, SHOWN).alias("_text")), id_col, "left")
    return rows.select(named, F.lit(kind).alias("kind"), F.lit(strategy).alias("strategy"), F.col("_text").alias("text"), "v")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))
