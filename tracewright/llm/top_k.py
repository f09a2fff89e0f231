"""Exact top-k inner products with M-trees: best-first search over paged metric nodes.

Vectors get one more component, so that the largest inner product is the smallest Euclidean distance (Bachrach et al.,
2014). Vectors are dealt into blocks, and each block is bulk-loaded into a tree of its own: pages of entries with a
covering radius and the distance to the parent's object. Each block of queries searches each tree: pages wait in the order
of their least possible distance, and stored distances to the parent exclude entries before any distance is computed.
Bounds only exclude; the scores are integer inner products.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tracewright.llm.base import materialize, table

PAGE, FANOUT = 128, 16
#: Vectors in a tree, queries in a block.
BLOCK, QUERY_BLOCK = 8192, 512
K = 10
SCALE = 1024


@dataclass
class Page:
    """objects: routing objects of the children, or the lifted vectors of a leaf. to_parent: their distances to this page's own object."""

    objects: np.ndarray
    to_parent: np.ndarray
    radii: np.ndarray | None
    children: list[int] | None
    ids: np.ndarray | None


@dataclass
class MTree:
    """norm: the squared length of all lifted vectors."""

    pages: list[Page]
    root: int
    center: np.ndarray
    norm: float


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def build_tree(vectors: np.ndarray, ids: np.ndarray, seed: int = 3) -> MTree:
    """Bulk-loads: rows split around sampled objects until they fit a page; rows that cannot be told apart are split in order."""
    rng = np.random.default_rng(seed)
    v = vectors.astype(np.float64)
    lengths = np.einsum("ij,ij->i", v, v)
    norm = float(lengths.max())
    lifted = np.c_[v, np.sqrt(np.maximum(0, norm - lengths))]
    pages: list[Page] = []

    def load(rows: np.ndarray, center: np.ndarray) -> int:
        own = lifted[rows]
        if len(rows) <= PAGE:
            pages.append(Page(own, _distances(own, center), None, None, ids[rows]))
            return len(pages) - 1
        picks = own[rng.choice(len(rows), FANOUT, replace=False)]
        near = ((picks**2).sum(axis=1)[None, :] - 2 * own @ picks.T).argmin(axis=1)
        groups = [g for k in range(len(picks)) if len(g := np.flatnonzero(near == k))]
        if len(groups) == 1:
            groups = np.array_split(np.arange(len(rows)), FANOUT)
        objects = np.stack([own[g].mean(axis=0) for g in groups])
        radii = np.array([_distances(own[g], o).max() for g, o in zip(groups, objects, strict=True)])
        children = [load(rows[g], o) for g, o in zip(groups, objects, strict=True)]
        pages.append(Page(objects, _distances(objects, center), radii, children, None))
        return len(pages) - 1

    middle = lifted.mean(axis=0)
    return MTree(pages, load(np.arange(len(ids)), middle), middle, norm)


def search(tree: MTree, query: np.ndarray, k: int, skip: int) -> list[tuple[int, int]]:
    """The (score, id) with the k highest scores, ties to smaller ids; the id skip is left out."""
    best: list[tuple[int, int]] = []  # (score, -id), the worst first
    lifted = np.append(query.astype(np.float64), 0.0)
    size = float(lifted @ lifted) + tree.norm
    slack = 1e-9 * (1 + size)
    reach = np.inf  # an object farther than this is not among the best
    start = float(np.sqrt(((tree.center - lifted) ** 2).sum()))
    waiting = [(0.0, -1, tree.root, start)]
    while waiting:
        least, _, number, to_own = heapq.heappop(waiting)
        if least > reach:
            break
        page = tree.pages[number]
        spread = np.abs(to_own - page.to_parent)  # by the triangle inequality, from stored distances alone
        if page.ids is None:
            near = np.flatnonzero(spread - page.radii <= reach)
            far = _distances(page.objects[near], lifted)
            bounds = np.maximum(0, far - page.radii[near])
            for i, d, bound in zip(near.tolist(), far.tolist(), bounds.tolist(), strict=True):
                if bound <= reach:
                    heapq.heappush(waiting, (bound, page.children[i], page.children[i], d))
            continue
        near = np.flatnonzero(spread <= reach)
        scores = np.rint(page.objects[near, :-1] @ lifted[:-1]).astype(np.int64)
        ids = page.ids[near]
        if len(best) == k:
            good = scores >= best[0][0]
            scores, ids = scores[good], ids[good]
        for item in zip(scores.tolist(), (-ids).tolist(), strict=True):
            if item[1] == -skip:
                continue
            if len(best) < k:
                heapq.heappush(best, item)
            elif item > best[0]:
                heapq.heapreplace(best, item)
        if len(best) == k:
            reach = float(np.sqrt(max(0.0, size - 2 * best[0][0]) + slack)) * (1 + 1e-12) + 1e-6
    return [(s, -i) for s, i in best]


def whole_vectors(items: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, dim, packed): components as little-endian int64."""
    x = F.transform(F.col(vector_col), lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    bad = F.exists(F.col(vector_col), lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    sound = items.filter(F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & ~F.coalesce(bad, F.lit(True)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [np.array(v, np.int64).tobytes() for v in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], names=["id", "dim", "packed"])

    return sound.select(F.col(id_col).cast("long").alias("id"), F.size(vector_col).alias("dim"), x.alias("x")).mapInArrow(pack, "id long, dim int, packed binary")


def top_k(items: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, id, score) for each row with is_query (an expression over `id`), against all rows with another id.

    A component x counts as floor(scale * x), taken as double; scores up to 2**53 are exact. Rows whose id or vector is null, whose
    vector is empty or holds a null, NaN or infinity take no part; vectors of different lengths are never compared. Of equal
    vectors only the k + 1 smallest ids are kept, since no other can be among the best. Repeated rows count once. Other columns
    are not read. A query without any candidate has no rows.
    """
    spark = items.sparkSession
    vectors = materialize(whole_vectors(items, id_col, vector_col, scale).distinct(), "vectors")
    same = Window.partitionBy("dim", "packed").orderBy("id")
    kept = materialize(vectors.withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= k + 1).drop("_n"), "kept")
    queries = vectors.filter(is_query)
    blocks = {r["dim"]: max(1, -(-r["n"] // BLOCK)) for r in kept.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    asked = {r["dim"]: max(1, -(-r["n"] // QUERY_BLOCK)) for r in queries.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")

    def parts(of: dict[int, int]) -> Column:
        return F.create_map(*[F.lit(v) for pair in of.items() for v in pair])[F.col("dim")]

    def plant(group: pa.Table) -> pa.Table:
        dim, block = group.column("dim")[0].as_py(), group.column("block")[0].as_py()
        v = np.frombuffer(b"".join(group.column("packed").to_pylist()), np.int64).reshape(-1, dim)
        order = np.argsort(group.column("id").to_numpy(), kind="stable")
        tree = build_tree(v[order], group.column("id").to_numpy()[order])
        return pa.table({"dim": [dim], "block": [block], "tree": pa.array([pickle.dumps(tree, protocol=5)], pa.binary())}, schema=pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("tree", pa.binary())]))

    dealt = kept.withColumn("block", F.pmod(F.xxhash64("id"), parts(blocks)))
    trees = materialize(dealt.groupBy("dim", "block").applyInArrow(plant, "dim int, block long, tree binary"), "trees")
    grouped = queries.withColumn("part", F.pmod(F.xxhash64("id"), parts(asked))).groupBy("dim", "part").agg(F.collect_list(F.struct("id", "packed")).alias("asked"))
    every = grouped.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), parts(blocks).cast("long") - 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, tree = None, None
        for b in batches:
            for i in range(b.num_rows):
                blob = b.column(0)[i].as_py()
                if blob != raw:
                    raw, tree = blob, pickle.loads(blob)  # noqa: S301  written by plant()
                rows = [(q["id"], *found) for q in b.column(1)[i].as_py() for found in search(tree, np.frombuffer(q["packed"], np.int64), k, q["id"])]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["query_id", "id", "score"])

    found = trees.join(every, ["dim", "block"]).select("tree", "asked").mapInArrow(run, "query_id long, id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_k(table(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(100)) == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

QUERIES = {"op8_top_k": op8_top_k}
ORACLES = {"op8_top_k": _SQL}
