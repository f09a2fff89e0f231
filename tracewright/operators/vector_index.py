"""Approximate nearest vectors: an inverted file of k-means cells with product-quantised residuals, and exact ranks of what it finds.

Cells and codebooks are learned on the driver from a bounded sample (SAMPLE vectors, those with the smallest hashes of their ids);
every vector is then put into its cell and coded in tasks. A query visits the cells nearest to it. Cells of many vectors are split into
blocks, so no group holds a whole large cell; a group keeps the best of each query by the codes alone, and those few are ranked by their
full vectors. How many cells are visited is measured on the sample, for a share of true neighbours that is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tracewright.lineage import written

#: Vectors from which cells and codebooks are learned, at most; vectors of a block, at most about so many.
SAMPLE, BLOCK = 20_000, 20_000


@dataclass
class Index:
    """Unit vectors of one length. codebooks: parts x centres x length of a part, of what is left of a vector after its cell's centre."""

    cells: np.ndarray
    codebooks: np.ndarray
    probes: int

    @property
    def size(self) -> int:
        return self.cells.shape[1]

    def nearest_cells(self, vectors: np.ndarray, n: int) -> np.ndarray:
        far = ((self.cells**2).sum(axis=1)[None, :] - 2 * vectors @ self.cells.T).round(9)
        return np.argsort(far, axis=1, kind="stable")[:, :n]

    def codes(self, left: np.ndarray) -> np.ndarray:
        parts, _, width = self.codebooks.shape
        out = np.empty((len(left), parts), np.uint8)
        for p in range(parts):
            book, piece = self.codebooks[p], left[:, p * width : (p + 1) * width]
            out[:, p] = ((book**2).sum(axis=1)[None, :] - 2 * piece @ book.T).argmin(axis=1)
        return out

    def scores(self, query: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of the query with what the codes stand for."""
        parts, _, width = self.codebooks.shape
        table = np.stack([self.codebooks[p] @ query[p * width : (p + 1) * width] for p in range(parts)])
        return query @ self.cells[cell] + table[np.arange(parts)[None, :], codes].sum(axis=1)


def unit(vectors: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the vectors are of the size, finite and not zero; and those, scaled to length 1."""
    good = np.array([v is not None and len(v) == size and None not in v for v in map(lambda v: None if v is None else list(v), vectors)], bool)
    found = np.array([vectors[i] for i in np.flatnonzero(good)], np.float64).reshape(-1, size)
    length = np.sqrt((found**2).sum(axis=1))
    fine = np.isfinite(length) & (length > 0)
    good[np.flatnonzero(good)[~fine]] = False
    return good, found[fine] / length[fine, None]


def k_means(points: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        own = ((centres**2).sum(axis=1)[None, :] - 2 * points @ centres.T).argmin(axis=1)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def learn(items: DataFrame, share: float = 0.97, near: int = 10, per_cell: int = 40, parts: int = 16, centres: int = 64, sample: int = SAMPLE) -> Index | None:
    """items: id, v. The length of most sampled vectors is the index's; vectors of another length, null, zero or not finite aren't in it.

    share: of the `near` nearest of sampled vectors, how many lie in the cells that are visited. None where there is no vector to learn from.
    """
    picked = items.filter("v IS NOT NULL AND size(v) > 0").select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample).collect()  # bounded by sample
    if not picked:
        return None
    sizes, counts = np.unique([len(r["v"]) for r in picked], return_counts=True)
    size = int(sizes[counts.argmax()])
    _, points = unit([r["v"] for r in picked], size)
    if not len(points):
        return None
    cells = k_means(points, max(1, len(points) // per_cell))
    parts = max(p for p in range(1, parts + 1) if size % p == 0)
    width, plain = size // parts, Index(cells, np.zeros((1, 1, size)), len(cells))
    own = plain.nearest_cells(points, 1)[:, 0]
    left = points - cells[own]
    books = np.stack([np.pad(b := k_means(left[:, p * width : (p + 1) * width], centres), ((0, centres - len(b)), (0, 0)), mode="edge") for p in range(parts)])
    asked = points[: min(1000, len(points))]
    similar = asked @ points.T
    similar[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    true = np.argsort(-similar, axis=1, kind="stable")[:, : min(near, len(points) - 1)]
    if not true.size:
        return Index(cells, books, len(cells))
    place = np.argsort(plain.nearest_cells(asked, len(cells)), axis=1)  # of each cell in the order of each query
    deep = np.sort(np.take_along_axis(place, own[true], axis=1).ravel())
    return Index(cells, books, int(deep[min(len(deep) - 1, int(np.ceil(share * len(deep))) - 1)]) + 1)


def indexed(items: DataFrame, index: Index, block: int = BLOCK) -> DataFrame:
    """(cell, block, id, codes), in the shared folder: every vector that the index can hold."""

    def put(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            good, vectors = unit(part["v"].tolist(), index.size)
            cell = index.nearest_cells(vectors, 1)[:, 0] if len(vectors) else np.zeros(0, np.int64)
            codes = index.codes(vectors - index.cells[cell])
            yield pd.DataFrame({"id": part["id"].to_numpy()[good], "cell": cell.astype(np.int32), "codes": [c.tobytes() for c in codes]})

    coded = written(items.select(F.col("id").cast("long"), F.col("v").cast("array<double>").alias("v")).mapInPandas(put, "id long, cell int, codes binary"))
    blocks = coded.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("blocks"))  # one row for each cell: at most SAMPLE
    return written(coded.join(F.broadcast(blocks), "cell").select("cell", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), "id", "codes"))


def search(items: DataFrame, coded: DataFrame, index: Index, queries: DataFrame, k: int, again: int = 12) -> DataFrame:
    """(qid, rank, id, similarity, looked): the k rows of items (id, v) nearest to each query (qid, qv) by cosine, as far as the index finds them.

    coded: from indexed(items, index). Each group hands on the again * k best by code, of which the again * k best of all are ranked by
    their vectors; ties go to the smaller id. looked: rows whose codes were read for the query.
    """
    few, probes = again * k, min(index.probes, len(index.cells))

    def visits(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            good, vectors = unit(part["qv"].tolist(), index.size)
            if len(vectors):
                cells = index.nearest_cells(vectors, probes)
                yield pd.DataFrame({"qid": np.repeat(part["qid"].to_numpy()[good], probes), "cell": cells.ravel().astype(np.int32), "q": np.repeat(np.array([v.tobytes() for v in vectors], object), probes)})

    def best(key: tuple, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows):
            codes, ids = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(rows), -1), rows["id"].to_numpy()
            for qid, q in zip(asked["qid"].tolist(), asked["q"], strict=True):
                scores = index.scores(np.frombuffer(q), key[0], codes)
                top = np.lexsort((ids, -scores))[:few]
                out.append(pd.DataFrame({"qid": qid, "id": ids[top], "about": scores[top], "looked": [len(rows)] + [0] * (len(top) - 1)}))
        return pd.concat(out) if out else pd.DataFrame({"qid": [], "id": [], "about": [], "looked": []}).astype({"qid": "int64", "id": "int64", "looked": "int64"})

    asked = queries.select(F.col("qid").cast("long"), F.col("qv").cast("array<double>").alias("qv"))
    visited = asked.mapInPandas(visits, "qid long, cell int, q binary")
    blocks = coded.groupBy("cell").agg((F.max("block") + 1).alias("blocks"))  # one row for each cell
    visited = visited.join(F.broadcast(blocks), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "qid", "q")
    found = written(coded.groupBy("cell", "block").cogroup(visited.groupBy("cell", "block")).applyInPandas(best, "qid long, id long, about double, looked long"))
    looked = found.groupBy("qid").agg(F.sum("looked").alias("looked"))
    first = Window.partitionBy("qid").orderBy(F.desc("about"), "id")
    kept = found.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= few).select("qid", "id")
    pairs = kept.join(items.select(F.col("id").cast("long"), F.col("v").cast("array<double>").alias("v")), "id").join(asked, "qid")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    similarity = F.round(dot("v", "qv") / F.sqrt(dot("v", "v") * dot("qv", "qv")), 6)
    ranked = pairs.select("qid", "id", similarity.alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("similarity"), "id"))
    return ranked.withColumn("rank", rank).filter(F.col("rank") <= k).join(looked, "qid").select("qid", "rank", "id", "similarity", "looked")
