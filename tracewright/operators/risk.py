"""Features and risks of nodes, clusters and whole flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewright.functions.scalars import ladder, micros
from tracewright.operators.graph import ordinals, reach, undirected


def density(e: DataFrame) -> DataFrame:
    """One row: nodes, edges, directed density and mean degree; the last two are null for a single node."""
    n = e.select(F.explode(F.array("src", "dst")).alias("x")).agg(F.countDistinct("x").alias("nodes"))
    m = e.select("src", "dst").distinct().agg(F.count("*").alias("edges"))
    return n.crossJoin(m).select("nodes", "edges", F.round(F.try_divide(F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)), 8).alias("density"), F.round(F.try_divide(2 * F.col("edges"), F.col("nodes")), 6).alias("mean_degree"))  # one row each


def node_features(t: DataFrame, nodes: DataFrame, days: int) -> DataFrame:
    """(id, n_out, partners, volume, recent): of every node, 0 where it sends nothing; recent counts the last days before the newest transfer."""
    last = t.agg(F.max(micros(F.col("ts"))).alias("_last"))
    g = t.crossJoin(F.broadcast(last)).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"), F.countDistinct("dst").alias("partners"), F.round(F.sum("value"), 4).alias("volume"), F.count_if(micros(F.col("ts")) >= F.col("_last") - days * 86_400_000_000).alias("recent"))  # one row
    return nodes.join(g, "id", "left").fillna({"n_out": 0, "partners": 0, "volume": 0.0, "recent": 0})


def shared_clusters(t: DataFrame, seeds: DataFrame, hops: int, least: int) -> DataFrame:
    """(node): those within so many hops of the seeds over pairs with at least so many transfers between them; the seeds themselves if led back to."""
    pairs = t.filter("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    both = undirected(pairs)
    near = both.join(seeds.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
    return reach(both, near, hops - 1).select("node").distinct()


def edge_index(e: DataFrame) -> DataFrame:
    """(src_index, dst_index): edges by the ordinals of their ends."""
    o = ordinals(e.select(F.explode(F.array("src", "dst")).alias("node")), "node")
    a, b = o.select(F.col("node").alias("src"), F.col("ordinal").alias("src_index")), o.select(F.col("node").alias("dst"), F.col("ordinal").alias("dst_index"))
    return e.join(a, "src").join(b, "dst").select("src_index", "dst_index")


def flow_risk(t: DataFrame, pattern_risk: float, large: float) -> DataFrame:
    """One row: half of the worst pattern's risk, and points for large edges, a sparse graph, nodes on several chains and a quick pace; 0 to 100."""
    m = t.agg(F.count("*").alias("n"), ((F.max(micros(F.col("ts"))) - F.min(micros(F.col("ts")))) / 3.6e9).alias("h"), F.count_if(F.col("value") >= large).alias("big"), F.countDistinct("src", "dst").alias("e"))
    v = t.select(F.explode(F.array("src", "dst")).alias("x")).agg(F.countDistinct("x").alias("v"))
    c = t.groupBy("src").agg(F.countDistinct("chain").alias("k")).agg(F.count_if(F.col("k") > 1).alias("k"))
    sparse = F.coalesce(F.try_divide(F.col("e"), F.col("v") * (F.col("v") - 1)) < 0.1, F.lit(False)) & (F.col("v") >= 10)
    points = 0.5 * pattern_risk + F.least(F.lit(25), 5 * F.col("big")) + F.when(sparse, 10).otherwise(0) + F.when(F.col("k") >= 3, 15).otherwise(0) + F.when(F.coalesce(F.try_divide("n", "h") >= 10, F.lit(False)), 15).otherwise(0)
    return m.crossJoin(v).crossJoin(c).select(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), points)), 4).alias("risk"))  # one row each


def cluster_risk(chains: Column, usd: Column, moves: Column, circular: Column, hopping: Column, parallel: Column, confidence: Column) -> Column:
    """Points for chains, value, movements and kinds of coordination, and 20 times the doubt; 0 to 100."""
    points = ladder(chains, [(5, 20), (3, 10)], 0) + ladder(usd, [(1_000_000, 20), (100_000, 10)], 0) + ladder(moves, [(10, 20), (5, 10)], 0)
    points = points + F.when(circular, 30).otherwise(0) + F.when(hopping, 20).otherwise(0) + F.when(parallel, 10).otherwise(0) + 20 * (1 - confidence)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), points))


def subgraph_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(label, n, circular): nodes by label; circular is the rule of thumb that more than three nodes and three edges may flow in a circle."""
    n = nodes.groupBy("label").agg(F.count("*").alias("n"))
    sizes = nodes.agg(F.count("*").alias("_v")).crossJoin(edges.agg(F.count("*").alias("_e")))  # one row each
    return n.crossJoin(F.broadcast(sizes)).select("label", "n", ((F.col("_v") > 3) & (F.col("_e") > 3)).alias("circular"))
