"""Mixing sources to target weights with a min-cost flow over membership patterns.

Documents are aggregated by the set of sources that they belong to. A flow routes each pattern's words to the
quotas of its sources; the k-th repetition of a word costs more than the one before, so that the flow repeats
text only where fresh text has run out. Seeded documents then fill what the flow takes from each pattern.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tracewright.llm.base import WORD, materialize, table

#: Patterns and sources go through the driver; more of them than this is an error, not a sample.
MAX_PATTERNS = 100_000
#: A pattern's documents fall into so many seeded bins; only the bin at the cut is sorted.
BINS = 65_536
#: The part of a take that is near enough.
NEAR = 1000


@dataclass(frozen=True)
class Mix:
    """targets: words for each source. taken: words for each pattern. flows: words from a pattern to a source."""

    sizes: dict
    targets: dict
    taken: dict
    flows: dict


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_order(sources: list) -> list:
    """By code point, null last."""
    return sorted(sources, key=lambda s: (s is None, s or ""))


def share_targets(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Shares total by weight; no target exceeds most times its source's size, and what is over goes to the others."""
    targets, left, open_ = {}, float(total), [s for s in source_order(list(sizes))]
    while open_:
        unit = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if unit * weights[s] > most * sizes[s]]
        for s in full or open_:
            targets[s] = float(most * sizes[s]) if full else unit * weights[s]
        if not full:
            break
        left -= sum(targets[s] for s in full)
        open_ = [s for s in open_ if s not in targets]
    return targets


def min_cost_flow(supplies: dict, quotas: dict, costs: tuple[int, ...]) -> dict:
    """Words from patterns (tuples of sources) to quotas, by successive cheapest augmenting paths.

    supplies: words of each pattern; each copy of them is an arc of its own cost, and costs must not fall.
    """
    nodes: dict = {}
    number = lambda x: nodes.setdefault(x, len(nodes))
    start, end = number("start"), number("end")
    arcs: list[list] = []  # to, room, cost
    out: list[list[int]] = [[], []]

    def arc(a: int, b: int, room: int, cost: int) -> None:
        while len(out) < len(nodes):
            out.append([])
        out[a].append(len(arcs))
        arcs.append([b, room, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0, -cost])

    routes = {}
    for pattern in sorted(supplies, key=lambda p: [(s is None, s or "") for s in p]):
        here = number(("pattern", pattern))
        for cost in costs:
            arc(start, here, supplies[pattern], cost)
        for s in pattern:
            if s in quotas:
                there = number(("source", s))
                routes[pattern, s] = len(arcs)
                arc(here, there, len(costs) * supplies[pattern], 0)
    for s in source_order(list(quotas)):
        arc(number(("source", s)), end, quotas[s], 0)
    height = [0] * len(nodes)  # all first costs are at least 0, so Dijkstra's search works from the start
    while True:
        far, via, queue = {start: 0}, {}, [(0, start)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for k in out[a]:
                b, room, cost = arcs[k]
                if room and (e := d + cost + height[a] - height[b]) < far.get(b, float("inf")):
                    far[b], via[b] = e, k
                    heapq.heappush(queue, (e, b))
        if end not in far:
            break
        for a, d in far.items():
            height[a] += d
        at, path = end, []
        while at != start:
            path.append(via[at])
            at = arcs[via[at] ^ 1][0]
        amount = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= amount
            arcs[k ^ 1][1] += amount
    return {route: arcs[k ^ 1][1] for route, k in routes.items() if arcs[k ^ 1][1]}


def plan_mix(patterns: list[tuple[tuple, int]], weights: tuple[float, ...], share: float, most: int, costs: tuple[int, ...]) -> Mix:
    """patterns: (sources, words). Weights repeat over the sources in code point order."""
    sizes: dict = {}
    for members, words in patterns:
        for s in members:
            sizes[s] = sizes.get(s, 0) + words
    by_source = {s: weights[i % len(weights)] for i, s in enumerate(source_order(list(sizes)))}
    targets = share_targets(sizes, by_source, share * sum(w for _, w in patterns), most)
    flows = min_cost_flow(dict(patterns), {s: round(t) for s, t in targets.items()}, costs[:most])
    taken: dict = {}
    for (members, _), words in flows.items():
        taken[members] = taken.get(members, 0) + words
    return Mix(sizes, targets, taken, flows)


def select_seeded(sized: DataFrame, takes: list[tuple[int, int, int]]) -> DataFrame:
    """Adds copies to rows of (_row, _pattern, _hash, _size), so that each pattern's words come near its take.

    takes: (pattern, words, take). Every row gets take // words copies; rows in the order of their seeded hash
    get one more until the rest is used up. A histogram over the hash finds the bin of the cut, so no task
    sorts a whole pattern. The row at the cut doesn't fit; further passes cut the rows left that fit the gap in the same way,
    until the gap is under a NEAR-th of the take or no row fits. Where a row that goes over brings the words nearer than all
    that later passes took, it stands in their place. Rows without words get take // words copies only.
    """
    spark = sized.sparkSession
    bases = {p: take // words for p, words, take in takes if words}
    gaps = {p: take % words for p, words, take in takes if words}
    near = {p: take // NEAR for p, _, take in takes}
    cuts: dict[int, list] = {p: [] for p in bases}
    over: dict[int, list] = {p: [] for p in bases}  # (words too many, cuts before it, row)
    extra: dict[int, int] = {}
    key = F.struct(F.col("_bin").alias("bin"), F.col("_hash").alias("hash"), F.col("_size").alias("size"), F.col("_row").alias("row"))
    binned = sized.withColumn("_bin", F.shiftrightunsigned(F.col("_hash"), 48))

    def placed(patterns: list[int]) -> DataFrame:
        """The rows of patterns and whether a cut has taken them; a row for each pattern is sent along."""
        state = [(p, bases[p], gaps[p], cuts[p], extra.get(p)) for p in patterns] or [(-1, 0, 0, [], None)]
        known = spark.createDataFrame(state, "_pattern long, _base long, _gap long, _cuts array<struct<gap:long,key:struct<bin:long,hash:long,size:long,row:long>>>, _extra long")
        taken = F.exists("_cuts", lambda c: (F.col("_size") > 0) & (F.col("_size") <= c["gap"]) & (key <= c["key"]))
        return binned.join(F.broadcast(known), "_pattern", "left" if len(patterns) == len(bases) else "inner").withColumn("_taken", F.coalesce(taken, F.lit(False)))

    open_ = [p for p, g in gaps.items() if g > 0]
    while open_:
        left = placed(open_).filter("not _taken and _size > 0 and _gap is not null")
        fits = F.col("_size") <= F.col("_gap")
        bins = left.groupBy("_pattern", "_bin").agg(F.first("_gap").alias("_gap"), F.sum(F.when(fits, F.col("_size")).otherwise(0)).alias("_words"), F.min(F.when(~fits, F.struct("_size", "_row"))).alias("_over"))
        ordered = Window.partitionBy("_pattern").orderBy("_bin")
        bins = bins.withColumn("_before", F.sum("_words").over(ordered) - F.col("_words"))
        edge = (F.col("_before") <= F.col("_gap")) & (F.col("_gap") < F.col("_before") + F.col("_words"))
        found = bins.groupBy("_pattern").agg(F.min("_over").alias("over"), F.sum("_words").alias("words"), F.max(F.when(edge, F.struct("_bin", "_before"))).alias("edge")).collect()
        at = {r["_pattern"]: (r["edge"]["_bin"], r["edge"]["_before"]) for r in found if r["edge"] is not None}
        inner = {}
        if at:
            edges = spark.createDataFrame([(p, b, gaps[p] - before) for p, (b, before) in at.items()], "_pattern long, _bin long, _left long")
            inside = Window.partitionBy("_pattern").orderBy("_hash", "_size", "_row").rowsBetween(Window.unboundedPreceding, 0)
            close = left.filter(fits).join(F.broadcast(edges), ["_pattern", "_bin"]).withColumn("_sum", F.sum("_size").over(inside)).filter("_sum <= _left")
            inner = {r["_pattern"]: r for r in close.groupBy("_pattern").agg(F.max(key).alias("key"), F.max("_sum").alias("sum")).collect()}
        still = []
        for r in found:
            p, gap = r["_pattern"], gaps[r["_pattern"]]
            if r["over"] is not None:
                over[p].append((r["over"]["_size"] - gap, len(cuts[p]), r["over"]["_row"]))
            if not r["words"]:
                continue
            if p not in at:
                cut, used = (BINS, 0, 0, 0), r["words"]
            elif p in inner:
                cut, used = tuple(inner[p]["key"]), at[p][1] + inner[p]["sum"]
            else:
                cut, used = (at[p][0], -(1 << 63), -1, -1), at[p][1]
            cuts[p].append((gap, cut))
            gaps[p] -= used
            if gaps[p] > near[p]:
                still.append(p)
        open_ = still
    for p, found in over.items():
        if found and min(found)[0] < gaps[p]:
            _, kept, extra[p] = min(found)
            cuts[p] = cuts[p][:kept]
    done = placed(list(bases))
    return done.select("_row", (F.coalesce("_base", F.lit(0)) + F.col("_taken").cast("long") + F.coalesce(F.col("_extra") == F.col("_row"), F.lit(False)).cast("long")).alias("copies"))


def mix_documents(
    docs: DataFrame,
    members: Column,
    text_col: str = "text",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    costs: tuple[int, ...] = (1, 4),
    seed: int = 17,
    keep: tuple[str, ...] = ("doc_id",),
    id_col: str = "doc_id",
) -> tuple[DataFrame, Mix]:
    """Returns (documents, plan): one row for each input row with the columns of keep, _members, _size and _copies.

    members: the array of sources that a row belongs to; a null source is a source of its own, an empty array
    belongs nowhere and is never taken. Sizes are words; null and empty texts have none and are taken 0 times or
    as often as their pattern's base. Equal rows are separate rows; which of them is taken does not show.
    Empty tables give empty results. The same rows and seed give the same result however they are partitioned.
    """
    used = docs.select(*keep, F.transform(F.array_sort(F.array_distinct(members)), lambda s: s.cast("string")).alias("_members"), word_count(F.col(text_col)).alias("_size"))
    sized = materialize(used.withColumn("_hash", F.xxhash64(F.lit(seed), id_col, "_members", "_size")).withColumn("_row", F.monotonically_increasing_id()), "sized")
    found = sized.groupBy("_members").agg(F.sum("_size").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = sorted(((tuple(r["_members"]), int(r["words"])) for r in found), key=lambda p: [(s is None, s or "") for s in p[0]])
    plan = plan_mix(patterns, weights, share, most, costs)
    spark = docs.sparkSession
    numbered = spark.createDataFrame([(i, list(p)) for i, (p, _) in enumerate(patterns)] or [(-1, ["-"])], "_pattern long, _members array<string>")
    # to_json makes null members comparable in the join
    numbered = numbered.select("_pattern", F.to_json("_members").alias("_key"))
    with_pattern = sized.withColumn("_key", F.to_json("_members")).join(F.broadcast(numbered), "_key").drop("_key")
    takes = [(i, words, plan.taken.get(p, 0)) for i, (p, words) in enumerate(patterns)]
    copies = select_seeded(with_pattern.select("_row", "_pattern", "_hash", "_size"), takes)
    return sized.join(copies, "_row").select(*keep, "_members", "_size", F.col("copies").alias("_copies")), plan


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, plan = mix_documents(table(spark, sf_dir, "documents"), F.array("source"))
    per_source = [(s, plan.sizes[s], plan.targets[s]) for s in plan.sizes]
    sources = spark.createDataFrame(per_source, "_source string, source_size long, target double")
    source = F.col("_members")[0]
    return mixed.join(F.broadcast(sources), source.eqNullSafe(F.col("_source")), "left").select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_copies").alias("copies")
    )


QUERIES = {"op2_mixing": op2_mixing}
ORACLES: dict[str, str] = {}
