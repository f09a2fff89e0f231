"""Connected components by alternating large-star and small-star (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from tracewright.llm.base import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the smallest of them. Edges run from larger to smaller nodes."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _watched(edges: DataFrame, seen: Observation) -> DataFrame:
    """Counts the edges and sums a hash of them while they are written."""
    return edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of an edge; the component is its smallest node.

    Nodes are whole numbers. Nulls, loops and repeated edges are left out; no edges give no rows. Every round is written
    to the shared folder. A node with very many neighbours is never gathered: only minima and joins are taken.
    """
    ends = edges.select(F.col(u).alias("_a"), F.col(v).alias("_b")).filter("_a is not null and _b is not null and _a <> _b")
    e = ends.select(F.greatest("_a", "_b").alias("u"), F.least("_a", "_b").alias("v"))
    seen = Observation()
    state, mark = materialize(_watched(e.distinct(), seen), "edges"), None
    for _ in range(max_rounds):
        now = tuple(seen.get.values())
        if now == mark or not now[0]:
            break
        mark, seen = now, Observation()
        state = materialize(_watched(_small_star(_large_star(state)), seen), "edges", rows=2 * now[0])
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
