"""Graph operators over edges (src, dst, ...): degrees, paths, cycles, ranks, components, communities.

Walks are loops of joins, one for each hop, with the bound on hops as a parameter; ranks and labels are loops of joins and
aggregates. `cut` ends the lineage of a round, which later rounds read more than once; a written table by default.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from tracewright.lineage import written

Cut = Callable[[DataFrame], DataFrame]


def build(t: DataFrame, least: float = 0.0) -> DataFrame:
    """One edge for each ordered pair: number and sum of transfers, first time; loops and smaller transfers are dropped."""
    return t.filter((F.col("src") != F.col("dst")) & (F.col("value") >= least)).groupBy("src", "dst").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"), F.min("ts").alias("first_ts"))


def degrees(e: DataFrame) -> DataFrame:
    """In, out and both, of every node of an edge."""
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("i").cast("long").alias("n_in"), F.sum("o").cast("long").alias("n_out"), F.count("*").alias("degree"))


def reach(e: DataFrame, seeds: DataFrame, hops: int, cut: Cut = written) -> DataFrame:
    """(node, hop): the nodes within so many hops of the seeds (a column node), with the least number of hops."""
    seen = seeds.select("node", F.lit(0).alias("hop")).distinct()
    front = seen
    for hop in range(1, hops + 1):
        nxt = front.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = cut(nxt.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(front)
    return seen


def simple_paths(e: DataFrame, least: int, most: int, cut: Cut = written) -> DataFrame:
    """(start, end, nodes, length): paths of least to most edges on which no node returns."""
    step = cut(e.select("src", "dst"))
    paths = step.filter("src <> dst").select(F.array("src", "dst").alias("nodes"))
    found = paths if least <= 1 else paths.limit(0)
    for n in range(2, most + 1):
        paths = paths.join(step, F.element_at("nodes", -1) == F.col("src")).filter(~F.array_contains("nodes", F.col("dst"))).select(F.concat("nodes", F.array("dst")).alias("nodes"))
        paths = paths if n == most else cut(paths)  # the longest are read once
        if n >= least:
            found = found.unionByName(paths)
    found = found.select(F.element_at("nodes", 1).alias("start"), F.element_at("nodes", -1).alias("end"), "nodes")
    return found.withColumn("length", F.size("nodes") - 1)


def cycles(e: DataFrame, least: int, most: int, cut: Cut = written) -> DataFrame:
    """(nodes, length, total, balanced, hours): cycles of least to most edges, each once, from its smallest node.

    e has src, dst, value and perhaps ts. balanced: the population deviation of the edges' values is under a fifth of their mean.
    hours: between the first and the last transfer of its edges; null without ts. A cycle of n edges is a path of (n + 1) / 2 edges out
    of its smallest node and one of n / 2 edges back into it that meet in one node alone, so walks grow to half a cycle only. Walks hold
    nodes alone; the edges' values and times are joined to the cycles found.
    """
    ts = F.col("ts").cast("timestamp") if "ts" in e.columns else F.lit(None).cast("timestamp")
    step = cut(e.filter("src <> dst").groupBy("src", "dst").agg(F.sum("value").alias("value"), F.min(ts).alias("first"), F.max(ts).alias("last")))
    pair, none = step.select("src", "dst"), F.array().cast(f"array<{step.schema['src'].dataType.simpleString()}>")
    there = {1: pair.filter("src < dst").select(F.col("src").alias("start"), F.col("dst").alias("end"), none.alias("mid"))}
    back = {1: pair.filter("dst < src").select(F.col("dst").alias("start"), F.col("src").alias("begin"), none.alias("rest"))}
    # the longest walks out of an odd cycle, or back into an even one, are read once: no cut
    for n in range(2, (most + 1) // 2 + 1):
        grown = there[n - 1].join(pair, F.col("end") == F.col("src")).filter((F.col("dst") > F.col("start")) & ~F.array_contains("mid", F.col("dst")))
        grown = grown.select("start", F.col("dst").alias("end"), F.concat("mid", F.array("end")).alias("mid"))
        there[n] = grown if 2 * n > most else cut(grown)
    for n in range(2, most // 2 + 1):
        grown = back[n - 1].join(pair, F.col("begin") == F.col("dst")).filter((F.col("src") > F.col("start")) & ~F.array_contains("rest", F.col("src")))
        grown = grown.select("start", F.col("src").alias("begin"), F.concat(F.array("begin"), "rest").alias("rest"))
        back[n] = grown if 2 * n == most else cut(grown)
    found = None
    for n in range(max(2, least), most + 1):
        one, two = there[(n + 1) // 2], back[n // 2].withColumnRenamed("start", "_start")
        met = one.join(two, (F.col("start") == F.col("_start")) & (F.col("end") == F.col("begin")))
        closed = met.filter(~F.arrays_overlap("mid", "rest")).select(F.concat(F.array("start"), "mid", F.array("end"), "rest").alias("nodes"))
        found = closed if found is None else found.unionByName(closed)
    if found is None:
        raise ValueError(f"a cycle has at least 2 edges, not {most}")
    after = F.concat(F.slice("nodes", 2, F.size("nodes")), F.slice("nodes", 1, 1))
    sides = found.select("nodes", F.posexplode(F.arrays_zip(F.col("nodes").alias("src"), after.alias("dst")))).select("nodes", "pos", "col.src", "col.dst")
    found = sides.join(step, ["src", "dst"]).groupBy("nodes").agg(F.array_sort(F.collect_list(F.struct("pos", "value", "first", "last"))).alias("edges"))
    values = F.col("edges.value")
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    mean = total / F.size("edges")
    spread = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size("edges"))
    hours = (F.unix_micros(F.array_max("edges.last")) - F.unix_micros(F.array_min("edges.first"))) / 3_600_000_000
    return found.select("nodes", F.size("nodes").alias("length"), F.round(total, 2).alias("total"), F.coalesce(spread / F.nullif(mean, F.lit(0.0)) < 0.2, F.lit(False)).alias("balanced"), hours.alias("hours"))


def circular_flows(found: DataFrame) -> DataFrame:
    """cycles() with confidence and risk, higher for those that close within a day and for long ones; without times they count as slow."""
    quick = F.greatest(F.lit(0.0), 1 - F.coalesce("hours", F.lit(24.0)) / 24)
    long = F.least(F.lit(1.0), (F.col("length") - 2) / 5)
    return found.withColumns({"confidence": F.round(0.5 + 0.25 * quick + 0.25 * long, 6), "risk": F.round(F.least(F.lit(100.0), 60 + 20 * quick + 20 * long), 6)})


def trails(e: DataFrame, id_col: str, least: int, most: int, direction: str = "OUT", kinds: list[str] | None = None, starts: DataFrame | None = None, cut: Cut = written) -> DataFrame:
    """(start, end, edges, nodes, length): walks of least to most edges on which no edge returns; nodes may.

    e has id_col, src, dst and, for kinds (the types of edges to walk), kind. direction OUT follows edges, IN goes against them, BOTH does
    either; a loop is walked once. starts: a column node; without, walks start everywhere. Parallel edges are edges of their own; a row
    with a null end is no edge.
    """
    kept = e.filter("src IS NOT NULL AND dst IS NOT NULL")
    kept = kept if kinds is None else kept.filter(F.col("kind").isin(*kinds))
    out, into = kept.select(F.col(id_col).alias("_id"), F.col("src").alias("_a"), F.col("dst").alias("_b")), kept.select(F.col(id_col).alias("_id"), F.col("dst").alias("_a"), F.col("src").alias("_b"))
    if direction not in ("OUT", "IN", "BOTH"):
        raise ValueError(f"direction is OUT, IN or BOTH, not {direction}")
    step = {"OUT": out, "IN": into}.get(direction)
    step = cut(out.unionByName(into.filter("_a <> _b")) if step is None else step)
    first = step if starts is None else step.join(starts.select(F.col("node").alias("_a")).distinct(), "_a", "left_semi")
    walks = first.select(F.col("_a").alias("start"), F.col("_b").alias("end"), F.array("_id").alias("edges"), F.array("_a", "_b").alias("nodes"))
    found = walks if least <= 1 else None
    for n in range(2, most + 1):
        grown = walks.join(step, F.col("end") == F.col("_a")).filter(~F.array_contains("edges", F.col("_id")))
        walks = cut(grown.select("start", F.col("_b").alias("end"), F.concat("edges", F.array("_id")).alias("edges"), F.concat("nodes", F.array("_b")).alias("nodes")))
        if n >= least:
            found = walks if found is None else found.unionByName(walks)
    if found is None:
        raise ValueError(f"no length from {least} to {most}")
    return found.withColumn("length", F.size("edges"))


def decaying_paths(e: DataFrame, ratio: float, least: int, most: int, seconds: int | None = None, start_value: float = 0.0, cut: Cut = written) -> DataFrame:
    """Paths of least to most nodes on which each edge's value is at most ratio times the one before, later in time (peel chains).

    seconds: the most time between neighbours; then each hop is an equality on node and bin of time. start_value: the least of a first edge.
    """
    from tracewright.operators.interval import forward_join

    step = e.select("src", "dst", "value", "ts")
    p = step.filter(F.col("value") >= start_value).select(F.col("src").alias("start"), F.col("dst").alias("end"), F.array("src", "dst").alias("nodes"), F.col("value").alias("last"), F.col("ts").alias("last_ts"))
    found = None
    for n in range(3, most + 1):
        grown = forward_join(p, step, [("end", "src")], "last_ts", "ts", seconds) if seconds else p.join(step, F.col("end") == F.col("src"))
        p = cut(
            grown.filter((F.col("value") <= ratio * F.col("last")) & (F.col("ts") > F.col("last_ts")) & ~F.array_contains("nodes", F.col("dst")))
            .select("start", F.col("dst").alias("end"), F.concat("nodes", F.array("dst")).alias("nodes"), F.col("value").alias("last"), F.col("ts").alias("last_ts"))
        )
        if n >= least:
            found = p if found is None else found.unionByName(p)
        if n < most and p.isEmpty():
            break
    n = F.size("nodes")
    found = p if found is None else found
    return found.filter(n >= least).select("start", "end", "nodes", F.round(F.least(F.lit(0.95), 0.5 + 0.1 * (n - 4)), 2).alias("confidence"), F.least(F.lit(100), 50 + 10 * (n - 4)).cast("long").alias("risk"))


def pagerank(e: DataFrame, most: int = 100, damping: float = 0.85, tolerance: float = 1e-6, weight: str | None = None, cut: Cut = written) -> DataFrame:
    """(node, rank): ranks that sum to 1, the rank of nodes without out-edges spread over all.

    Rounds go on until the sum of changes is under tolerance times the number of nodes, at most so many. weight: a column by
    which a node's rank is dealt to its targets; without, parallel edges are one and all targets get the same.
    """
    step = e.groupBy("src", "dst").agg((F.sum(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    out = step.groupBy("src").agg(F.sum("w").alias("k"))
    edge = cut(step.join(out, "src").select("src", "dst", (F.col("w") / F.col("k")).alias("share")))
    nodes = cut(edge.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(out.select(F.col("src").alias("node"), F.lit(True).alias("gives")), "node", "left"))
    n = nodes.count()
    rank = nodes.withColumn("rank", F.lit(1.0 / max(1, n)))
    for _ in range(most):
        idle = rank.filter("gives IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("idle"))
        got = edge.join(rank.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("idle") / n) if n else F.lit(0.0)
        now = cut(rank.join(got, "node", "left").crossJoin(F.broadcast(idle)).select("node", "gives", F.col("rank").alias("was"), new.alias("rank")))  # one row
        rank = now.select("node", "gives", "rank")
        if (now.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0) < tolerance * n:
            break
    return rank.select("node", "rank")


def risk_spread(e: DataFrame, seeds: DataFrame, rounds: int = 3, decay: float = 0.5, cut: Cut = written) -> DataFrame:
    """Personalised ranks: each round a node's risk is (1 - decay) of its seed and decay of what its predecessors pass on."""
    step = e.select("src", "dst").distinct()
    nodes = step.select(F.col("src").alias("node")).union(step.select("dst")).union(seeds.select("node")).distinct()
    edge = step.join(step.groupBy("src").agg(F.count("*").alias("k")), "src")
    base = nodes.join(seeds.groupBy("node").agg(F.max("risk").alias("risk")), "node", "left").select("node", F.coalesce("risk", F.lit(0.0)).alias("seed"))
    now = base.select("node", F.col("seed").alias("risk"))
    for _ in range(rounds):
        got = edge.join(now, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("risk") / F.col("k")).alias("got")).withColumnRenamed("dst", "node")
        now = cut(base.join(got, "node", "left").select("node", ((1 - decay) * F.col("seed") + decay * F.coalesce("got", F.lit(0.0))).alias("risk")))
    return now


def components(e: DataFrame, cut: Cut = written, most: int = 60) -> DataFrame:
    """(node, component): the smallest node that is reachable, by rounds of minima over neighbours and a jump to the component's own.

    Rounds go on until no node changes; each is cut, since it reads the one before three times.
    """
    both = cut(e.select("src", "dst").union(e.select("dst", "src")).distinct())
    label = cut(both.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")))
    for _ in range(most):
        near = both.join(label, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("component").alias("near")).withColumnRenamed("src", "node")
        least = label.join(near, "node", "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = label.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        now = cut(least.join(jump, F.col("component") == F.col("_n"), "left").select("node", "was", F.least("component", F.coalesce("_c", "component")).alias("component")))
        label = now.select("node", "component")
        if now.filter("component <> was").isEmpty():
            return label
    raise RuntimeError(f"components have not settled after {most} rounds")


def triangles(e: DataFrame) -> DataFrame:
    """Of each node: undirected neighbours, triangles, local clustering coefficient.

    Edges point from the end of smaller degree to the other (ties by node), so that a hub's edges are never paired with each other.
    """
    u = e.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    d = u.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    ends = u.join(d.select(F.col("node").alias("a"), F.col("degree").alias("da")), "a").join(d.select(F.col("node").alias("b"), F.col("degree").alias("db")), "b")
    first = F.struct("da", "a") < F.struct("db", "b")
    o = ends.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("p"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("q"), F.greatest(F.struct(F.col("da").alias("d"), F.col("a").alias("n")), F.struct(F.col("db").alias("d"), F.col("b").alias("n"))).alias("place"))
    wedge = o.join(o.select("p", F.col("q").alias("r"), F.col("place").alias("place2")), "p").filter("place < place2").select("p", "q", "r")
    close = o.select(F.col("p").alias("q2"), F.col("q").alias("r2"))
    t = wedge.join(close, (F.col("q") == F.col("q2")) & (F.col("r") == F.col("r2"))).select(F.explode(F.array("p", "q", "r")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    k = F.coalesce("triangles", F.lit(0)).cast("long")
    return d.join(t, "node", "left").select("node", "degree", k.alias("triangles"), F.round(F.when(F.col("degree") > 1, 2.0 * k / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0), 6).alias("clustering"))


def hubs(t: DataFrame, least: int = 2, ratio: float = 0.7, sure: float = 0.5) -> DataFrame:
    """Nodes that gather and pass on: in and out of at least so many, values alike, in before out or overlapping in time."""
    i = t.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"), F.sum("value").alias("vi"), F.min("ts").alias("i0"), F.max("ts").alias("i1"))
    o = t.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"), F.sum("value").alias("vo"), F.min("ts").alias("o0"), F.max("ts").alias("o1"))
    us = lambda c: F.unix_micros(F.col(c))
    both = i.join(o, "node").filter((F.col("n_in") >= least) & (F.col("n_out") >= least))
    span = F.greatest(us("i1"), us("o1")) - F.least(us("i0"), us("o0"))
    overlap = F.greatest(F.lit(0), F.least(us("i1"), us("o1")) - F.greatest(us("i0"), us("o0")))
    conf = F.when(F.col("i1") <= F.col("o0"), 0.9).otherwise(0.7 * (1 - F.try_divide(overlap, span)))
    r = F.least("vi", "vo") / F.greatest("vi", "vo")
    out = both.withColumn("confidence", F.coalesce(conf, F.lit(0.0))).withColumn("ratio", r).filter((F.col("confidence") >= sure) & (F.col("ratio") >= ratio))
    return out.select("node", "n_in", "n_out", F.round("ratio", 6).alias("ratio"), F.round("confidence", 6).alias("confidence"), F.round(F.least(F.lit(100.0), 50 + 30 * F.col("confidence") + 20 * F.col("ratio")), 2).alias("risk"))


def label_pairs(e: DataFrame, nodes: DataFrame, most: int = 100) -> DataFrame:
    """How often each kind of node leads to each other kind; nodes has node and label."""
    a, b = nodes.select(F.col("node").alias("src"), F.col("label").alias("from_label")), nodes.select(F.col("node").alias("dst"), F.col("label").alias("to_label"))
    return e.join(a, "src").join(b, "dst").groupBy("from_label", "to_label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "from_label", "to_label").limit(most)


def neighbours_alike(e: DataFrame, labels: DataFrame) -> DataFrame:
    """Of each node: how many of its targets carry its own label."""
    a, b = labels.select(F.col("node").alias("src"), F.col("label").alias("la")), labels.select(F.col("node").alias("dst"), F.col("label").alias("lb"))
    return e.join(a, "src").join(b, "dst").groupBy("src").agg(F.sum((F.col("la") == F.col("lb")).cast("long")).alias("alike"), F.count("*").alias("n"))


def undirected(e: DataFrame) -> DataFrame:
    """(src, dst): every edge in both directions, once, without loops."""
    return e.filter("src <> dst").select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*").distinct()


def subgraph(e: DataFrame, seeds: DataFrame, hops: int, cut: Cut = written) -> DataFrame:
    """The edges both ends of which lie within so many hops of the seeds, in either direction."""
    near = cut(reach(undirected(e), seeds, hops, cut).select("node"))
    return e.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi")


def distances(e: DataFrame, most: int, cut: Cut = written, starts: DataFrame | None = None) -> DataFrame:
    """(start, node, hops): all pairs within so many directed hops, by their shortest paths; start to itself is 0.

    A row for each pair that is near enough: meant for communities and other small graphs. starts: a column node; without, all nodes.
    """
    step = cut(e.filter("src <> dst").select("src", "dst").distinct())
    starts = step.select(F.explode(F.array("src", "dst")).alias("node")).distinct() if starts is None else starts
    seen = front = cut(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops")))
    for k in range(1, most + 1):
        nxt = front.join(step, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        front = cut(nxt.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(k)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def shortest_paths(e: DataFrame, pairs: DataFrame, most: int, cut: Cut = written) -> DataFrame:
    """(start, end, length, nodes): of each wanted pair (start, end) a shortest undirected path of at most so many edges; the smallest node by node.

    A breadth-first search from each start, or from each end where those are fewer, that keeps one path to each node; those whose
    partners are all reached rest. Rows are at most the nodes times the fewer of starts and ends.
    """
    step = cut(undirected(e))
    want = cut(pairs.select("start", "end").dropna().distinct())
    few = want.agg(F.countDistinct("start").alias("s"), F.countDistinct("end").alias("e")).first()
    seed, goal = ("end", "start") if few["e"] < few["s"] else ("start", "end")
    longer = F.concat("nodes", F.array("dst")) if seed == "start" else F.concat(F.array("dst"), "nodes")
    front = cut(want.select(seed).distinct().select(F.col(seed).alias("_seed"), F.col(seed).alias("node"), F.array(seed).alias("nodes")))
    seen, found = front.select("_seed", "node"), None
    for k in range(most + 1):
        hit = cut(front.join(want, (F.col("_seed") == F.col(seed)) & (F.col("node") == F.col(goal))).select("start", "end", F.lit(k).alias("length"), "nodes"))
        found = hit if found is None else found.unionByName(hit)
        want = cut(want.join(hit.select("start", "end"), ["start", "end"], "left_anti"))
        if k == most or want.isEmpty():
            break
        live = front.join(want.select(F.col(seed).alias("_seed")).distinct(), "_seed", "left_semi")
        nxt = live.join(step, F.col("node") == F.col("src")).groupBy("_seed", F.col("dst").alias("node")).agg(F.min(longer).alias("nodes"))
        front = cut(nxt.join(seen, ["_seed", "node"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("_seed", "node"))
    return found


def _numbered(e: DataFrame, cut: Cut) -> tuple[DataFrame, DataFrame]:
    """(node, ordinal), and the distinct edges between ordinals, packed; no loops."""
    from tracewright.operators import registers

    step = cut(e.filter("src <> dst").select("src", "dst").distinct())
    number = cut(ordinals(step.select(F.explode(F.array("src", "dst")).alias("node")), "node"))
    a, b = number.select(F.col("node").alias("src"), F.col("ordinal").alias("_a")), number.select(F.col("node").alias("dst"), F.col("ordinal").alias("_b"))
    return number, cut(registers.packed(step.join(a, "src").join(b, "dst").select(F.col("_a").alias("src"), F.col("_b").alias("dst"))))


def closeness(e: DataFrame, cut: Cut = written, rows: int | None = None) -> DataFrame:
    """(node, closeness): by the lengths of paths into a node, however long, scaled by the share of nodes that reach it.

    Slices of starts are searched side by side and give sums by node alone (see searches.py), so that disk grows with the nodes; time
    grows with the nodes times the edges, by 64 starts at once. rows: pairs of a start and a node that a task holds, where fewer than fit.
    """
    from tracewright.operators import searches

    number, edges = _numbered(e, cut)
    n = number.count()
    sums = searches.hops(edges, number.select("ordinal"), n, rows).join(number, "ordinal")
    return cut(sums.select("node", F.coalesce(F.try_divide((F.col("reached") - 1) * (F.col("reached") - 1), F.col("hops") * F.lit(n - 1)), F.lit(0.0)).alias("closeness")))


def path_lengths(e: DataFrame, most: int = 50, cut: Cut = written) -> DataFrame:
    """One row: nodes, mean length of shortest directed paths and diameter; both null unless every node reaches every other."""
    g = distances(e, most, cut).agg(F.countDistinct("start").alias("nodes"), F.sum("hops").alias("_s"), F.max("hops").alias("_d"), F.count("*").alias("_p"))
    whole = F.col("_p") == F.col("nodes") * F.col("nodes")
    return g.select("nodes", F.when(whole, F.try_divide(F.col("_s"), F.col("nodes") * (F.col("nodes") - 1))).alias("mean_length"), F.when(whole, F.col("_d")).alias("diameter"))


def betweenness(e: DataFrame, cut: Cut = written, sources: int | None = None, rows: int | None = None) -> DataFrame:
    """(node, betweenness): the share of shortest directed paths, however long, that pass through, over all pairs, divided by (n - 1)(n - 2).

    sources: so many starts only, those with the smallest hashes, each standing for n / sources of them; rows then grow with the nodes.
    By Hoeffding's bound a value is off by more than sqrt(ln(2 / p) / (2 * sources)) * n / (n - 1) with a chance of p at most.

    Slices of starts are searched side by side and give sums by node alone (see searches.py), so that disk grows with the nodes; time
    grows with the starts times the edges. rows: pairs of a start and a node that a task holds, where fewer than fit.
    """
    from tracewright.operators import searches

    number, edges = _numbered(e, cut)
    starts = number if sources is None else cut(number.orderBy(F.xxhash64(F.col("node").cast("string")), "node").limit(sources))
    count = number.count()
    sums = searches.dependencies(edges, starts.select("ordinal"), count, rows).withColumnRenamed("dependency", "b")
    stands_for, scale = 1.0 if sources is None or not count else count / min(count, sources), (count - 1) * (count - 2)
    return cut(number.join(sums, "ordinal", "left").select("node", F.coalesce(F.try_divide(F.col("b") * stands_for, F.lit(scale)), F.lit(0.0)).alias("betweenness")))


def reach_sketches(e: DataFrame, most: int = 50, bits: int = 12, cut: Cut = written) -> DataFrame:
    """(node, hops, n): about how many nodes, itself included, reach each node in at most so many hops, for hops from 0 until none changes.

    Each node has 2 ** bits HyperLogLog registers; a round takes the largest of its own and its sources' in slices of registers, so that
    no sketch goes along an edge (see registers.py). Counts of a few nodes are exact but where two of them share a register; the
    relative standard error of others is about 1.04 / sqrt(2 ** bits), 1.7 % for 12.
    """
    from tracewright.operators import registers

    step = cut(e.filter("src <> dst").select("src", "dst").distinct())
    number = cut(ordinals(step.select(F.explode(F.array("src", "dst")).alias("node")), "node"))
    a, b = number.select(F.col("node").alias("src"), F.col("ordinal").alias("_a")), number.select(F.col("node").alias("dst"), F.col("ordinal").alias("_b"))
    edges = step.join(a, "src").join(b, "dst").select(F.col("_a").alias("src"), F.col("_b").alias("dst"))
    balls = registers.balls(edges, number.select("ordinal", F.xxhash64(F.col("node").cast("string")).alias("hash")), number.count(), most, bits, cut)
    return cut(balls.join(number, "ordinal").select("node", "hops", "n"))


def closeness_sketched(e: DataFrame, most: int = 50, bits: int = 12, cut: Cut = written) -> DataFrame:
    """closeness() from reach_sketches(): (node, closeness), about exact to twice the sketches' error."""
    balls = reach_sketches(e, most, bits, cut)
    rings = balls.withColumn("_new", F.col("n") - F.coalesce(F.lag("n").over(Window.partitionBy("node").orderBy("hops")), F.lit(0)))  # as many rows as hops
    g = rings.groupBy("node").agg(F.sum(F.col("hops") * F.col("_new")).alias("_s"), F.max("n").alias("_r"))
    n = balls.filter("hops = 0").count()
    return g.select("node", F.coalesce(F.try_divide((F.col("_r") - 1) * (F.col("_r") - 1), F.col("_s") * F.lit(n - 1)), F.lit(0.0)).alias("closeness"))


def path_lengths_sketched(e: DataFrame, most: int = 50, bits: int = 12, cut: Cut = written) -> DataFrame:
    """One row from reach_sketches(): nodes, mean_length (of shortest paths between nodes that reach one another), reachable (share of pairs) and diameter (hops until no count grows)."""
    balls = reach_sketches(e, most, bits, cut)
    rings = balls.withColumn("_new", F.col("n") - F.coalesce(F.lag("n").over(Window.partitionBy("node").orderBy("hops")), F.lit(0)))
    g = rings.agg(F.count_if(F.col("hops") == 0).alias("nodes"), F.sum(F.col("hops") * F.col("_new")).alias("_s"), F.sum(F.when(F.col("hops") > 0, F.col("_new"))).alias("_p"), F.max("hops").alias("diameter"))
    return g.select("nodes", F.try_divide("_s", "_p").alias("mean_length"), F.try_divide(F.col("_p"), F.col("nodes") * (F.col("nodes") - 1)).alias("reachable"), "diameter")


def strong_components(e: DataFrame, cut: Cut = written, most: int = 200) -> DataFrame:
    """(node, component): the smallest node of those that reach one another.

    Each round, nodes take the smallest colour that leads to them (forward minima until they settle); nodes of one colour that
    lead back to the colour's own node form a component and leave the graph.
    """
    left = cut(e.select("src", "dst").filter("src <> dst").distinct())
    alive = cut(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    done = None
    for _ in range(most):
        colour = cut(alive.withColumn("colour", F.col("node")))
        for _ in range(most):
            got = left.join(colour, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("_c"))
            now = cut(colour.join(got, "node", "left").select("node", F.col("colour").alias("was"), F.least("colour", F.coalesce("_c", "colour")).alias("colour")))
            colour = now.select("node", "colour")
            if now.filter("was <> colour").isEmpty():
                break
        else:
            raise RuntimeError(f"colours have not settled after {most} rounds")
        inner = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst").filter("a = b").select("src", "dst", "a")
        back = cut(colour.filter("node = colour"))
        front = back
        for _ in range(most):
            nxt = front.join(inner, (F.col("node") == F.col("dst")) & (F.col("colour") == F.col("a"))).select(F.col("src").alias("node"), "colour").distinct()
            front = cut(nxt.join(back.select("node"), "node", "left_anti"))
            if front.isEmpty():
                break
            back = cut(back.unionByName(front))
        found = back.select("node", F.col("colour").alias("component"))
        done = found if done is None else cut(done.unionByName(found))
        alive = cut(alive.join(back.select("node"), "node", "left_anti"))
        if alive.isEmpty():
            return done
        left = cut(left.join(alive.select(F.col("node").alias("src")), "src", "left_semi").join(alive.select(F.col("node").alias("dst")), "dst", "left_semi"))
    raise RuntimeError(f"components have not settled after {most} rounds")


def label_propagation(e: DataFrame, rounds: int = 10, cut: Cut = written) -> DataFrame:
    """(node, community): each round a node takes the most frequent label of its undirected neighbours, ties to the smallest."""
    both = cut(undirected(e))
    label = both.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = both.join(label, F.col("dst") == F.col("node")).groupBy("src", "community").agg(F.count("*").alias("n"))
        label = cut(votes.groupBy(F.col("src").alias("node")).agg(F.min(F.struct(F.negate("n").alias("n"), "community"))["community"].alias("community")))
    return label


def modularity(e: DataFrame, community: DataFrame) -> DataFrame:
    """One row: modularity of a partition (node, community) of the undirected graph of e; parallel edges count by weight (value, if e has it)."""
    w = F.col("value") if "value" in e.columns else F.lit(1.0)
    u = e.filter("src <> dst").select("src", "dst", w.cast("double").alias("w"))
    placed = u.join(community.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(community.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    inside = placed.groupBy().agg(F.sum("w").alias("m"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("w"))), F.lit(0.0)).alias("inside"))
    ends = placed.select(F.explode(F.array(F.struct(F.col("a").alias("c"), "w"), F.struct(F.col("b").alias("c"), "w"))).alias("x")).groupBy("x.c").agg(F.sum("x.w").alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    return inside.crossJoin(F.broadcast(ends)).select((F.try_divide(F.col("inside"), F.col("m")) - F.try_divide(F.col("dd"), 4 * F.col("m") * F.col("m"))).alias("modularity"))  # one row


def louvain(e: DataFrame, levels: int = 5, rounds: int = 10, cut: Cut = written) -> DataFrame:
    """(node, community): greedy modularity over levels of a shrinking graph; weights are value, if e has it.

    Each round every node looks at the gain of joining each neighbour's community and half of the nodes (by a hash that
    changes with the round) may move, so that neighbours don't swap places for ever. A level ends when few move; its
    communities are the next level's nodes. Communities are named after their smallest node.
    """
    w = F.col("value") if "value" in e.columns else F.lit(1.0)
    both = e.filter("src <> dst").select(F.explode(F.array(F.struct("src", "dst", w.cast("double").alias("w")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), w.cast("double").alias("w")))).alias("x")).groupBy("x.src", "x.dst").agg(F.sum("x.w").alias("w"))
    both = cut(both)
    placed = cut(both.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node")))
    total = both.agg(F.sum("w")).first()[0]
    if not total:
        return placed
    for _ in range(levels):
        degree = cut(both.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")))
        own = cut(degree.select("node", "k", F.col("node").alias("c")))
        moved_ever = False
        for r in range(rounds):
            sums = own.groupBy("c").agg(F.sum("k").alias("tot"))
            links = both.filter("src <> dst").join(own.select(F.col("node").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("node"), "c").agg(F.sum("w").alias("to"))
            choices = links.unionByName(own.select("node", "c", F.lit(0.0).alias("to"))).groupBy("node", "c").agg(F.sum("to").alias("to"))
            gains = choices.join(sums, "c").join(own.select("node", "k", F.col("c").alias("now")), "node")
            rest = F.col("tot") - F.when(F.col("c") == F.col("now"), F.col("k")).otherwise(0.0)
            best = gains.select("node", "k", "now", "c", F.round(F.col("to") - F.col("k") * rest / total, 9).alias("gain")).groupBy("node", "k", "now").agg(F.min(F.struct(F.negate("gain").alias("g"), (F.col("c") != F.col("now")).alias("other"), "c"))["c"].alias("best"))
            turn = F.pmod(F.xxhash64(F.col("node"), F.lit(r)), F.lit(2)) == 0
            now = cut(best.select("node", "k", "now", F.when(turn, F.col("best")).otherwise(F.col("now")).alias("c"), (F.col("best") != F.col("now")).alias("wants")))
            own = now.select("node", "k", "c")
            moved_ever = moved_ever or not now.filter("now <> c").isEmpty()
            if now.filter("wants").isEmpty():
                break
        if not moved_ever:
            break
        to = own.select(F.col("node").alias("community"), F.col("c").alias("next"))
        placed = cut(placed.join(to, "community").select("node", F.col("next").alias("community")))
        named = own.select("node", "c")
        both = cut(both.join(named.select(F.col("node").alias("src"), F.col("c").alias("a")), "src").join(named.select(F.col("node").alias("dst"), F.col("c").alias("b")), "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
    name = placed.groupBy("community").agg(F.min("node").alias("least"))
    return placed.join(name, "community").select("node", F.col("least").alias("community"))


def community_sizes(community: DataFrame, least: int, most: int) -> DataFrame:
    """(community, size): the largest, of at least so many nodes."""
    return community.groupBy("community").agg(F.count("*").alias("size")).filter(F.col("size") >= least).orderBy(F.desc("size"), "community").limit(most)


def inner_edges(e: DataFrame, community: DataFrame) -> DataFrame:
    """(community, n, value): edges inside each community, their number and sum."""
    a, b = community.select(F.col("node").alias("src"), F.col("community").alias("community")), community.select(F.col("node").alias("dst"), F.col("community").alias("_b"))
    return e.join(a, "src").join(b, "dst").filter("community = _b").groupBy("community").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def centralisation(values: DataFrame, column: str) -> DataFrame:
    """One row: the sum of what each value lacks to the largest, over (n - 1) squared; 0 for a single one."""
    g = values.agg(F.max(column).alias("m"), F.sum(column).alias("s"), F.count("*").alias("n"))
    return g.select(F.coalesce(F.try_divide(F.col("m") * F.col("n") - F.col("s"), (F.col("n") - 1) * (F.col("n") - 1)), F.lit(0.0)).alias("centralisation"))


def unusual_share(t: DataFrame, degree: int, value: float) -> DataFrame:
    """One row: half of the share of nodes over a degree and half of the share of transfers over a value, and the severity at .6."""
    d = degrees(t).agg(F.avg((F.col("degree") > degree).cast("double")).alias("a"))
    v = t.agg(F.avg((F.col("value") > value).cast("double")).alias("b"))
    score = 0.5 * F.col("a") + 0.5 * F.col("b")
    return d.crossJoin(v).select(F.round(score, 6).alias("score"), F.when(score > 0.9, "CRITICAL").when(score > 0.78, "HIGH").when(score > 0.66, "MEDIUM").otherwise("LOW").alias("severity"))  # one row each


def community_outliers(e: DataFrame, community: DataFrame, least: float) -> DataFrame:
    """(node, community, score): .7 of how far a node's degree lies from its community's mean, in deviations, and .3 of its neighbours inside over the size."""
    d = degrees(e).select("node", "degree").join(community, "node")
    g = d.groupBy("community").agg(F.avg("degree").alias("m"), F.stddev_samp("degree").alias("s"), F.count("*").alias("size"))
    near = undirected(e).join(community.select(F.col("node").alias("src"), "community"), "src").join(community.select(F.col("node").alias("dst"), F.col("community").alias("_b")), "dst").filter("community = _b").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("c"))
    score = 0.7 * F.coalesce(F.try_divide(F.abs(F.col("m") - F.col("degree")), F.col("s")), F.lit(0.0)) + 0.3 * F.coalesce("c", F.lit(0)) / F.col("size")
    return d.join(g, "community").join(near, "node", "left").select("node", "community", score.alias("score")).filter(F.col("score") >= least)


def in_cycles(found: DataFrame, least: int = 2) -> DataFrame:
    """(node, n): nodes that lie on at least so many cycles."""
    return found.select(F.explode("nodes").alias("node")).groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def rapid_paths(t: DataFrame, least: int, most: int, seconds: int, cut: Cut = written) -> DataFrame:
    """(start, end, length, token, micros): paths of transfers of one token, each later than the one before, all within so many seconds, that end elsewhere.

    micros: from the first transfer to the last. t has src, dst, ts, token. Each hop is an equality on node, token and bin of time.
    """
    from tracewright.operators.interval import forward_join

    micros = (F.unix_micros("last_ts") - F.unix_micros("first_ts")).alias("micros")
    step = t.select(F.col("src").alias("s"), F.col("dst").alias("d"), F.col("ts").alias("next_ts"), F.col("token").alias("k"))
    p = t.select(F.col("src").alias("start"), F.col("dst").alias("end"), F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"), "token", F.lit(1).alias("length"))
    found = None
    for n in range(2, most + 1):
        grown = forward_join(p, step, [("end", "s"), ("token", "k")], "last_ts", "next_ts", seconds).filter((F.col("next_ts") > F.col("last_ts")) & (F.unix_micros("next_ts") - F.unix_micros("first_ts") <= seconds * 1_000_000))
        p = cut(grown.select("start", F.col("d").alias("end"), "first_ts", F.col("next_ts").alias("last_ts"), "token", F.lit(n).alias("length")))
        if n >= least:
            hit = p.filter("start <> end").select("start", "end", "length", "token", micros)
            found = hit if found is None else found.unionByName(hit)
        if p.isEmpty():
            break
    return found if found is not None else p.filter("false").select("start", "end", "length", "token", micros)


def clusters(pairs: DataFrame, members: DataFrame, cut: Cut = written) -> DataFrame:
    """(component, size, value, first_ts, last_ts): members (node, value, ts) merged by pairs (src, dst); a member without pairs is a cluster of its own."""
    c = components(pairs, cut)
    placed = members.join(c, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return placed.groupBy("component").agg(F.countDistinct("node").alias("size"), F.sum("value").alias("value"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def ordinals(nodes: DataFrame, key: str) -> DataFrame:
    """(key, ordinal): numbers from 0 in order of key. Keys are dealt out by range; a part's numbers start after the sum of those before."""
    parts = written(nodes.select(key).distinct().repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    from pyspark.sql import Window

    sums = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    sums = sums.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each part
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return parts.withColumn("_i", inside).join(F.broadcast(sums), F.col("_part") == F.col("_p")).select(key, (F.col("_before") + F.col("_i")).alias("ordinal"))
