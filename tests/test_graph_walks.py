"""Cycles, trails and sketches against plain Python on random graphs and multigraphs, with loops, parallel and null edges."""

import math
import random
from collections import Counter, defaultdict, deque
from datetime import datetime, timedelta

import pytest

from tracewright import catalog
from tracewright.lineage import written
from tracewright.operators import graph

START = datetime(2024, 1, 1)


def multigraph(seed, nodes=7, n=26):
    rng = random.Random(seed)
    return [(i, rng.choice([None, *range(nodes)] if i % 9 == 0 else range(nodes)), rng.randrange(nodes), float(rng.choice([10, 11, 50])), START + timedelta(hours=rng.randrange(40)), rng.choice("xyz")) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, src long, dst long, value double, ts timestamp, kind string").repartition(3)


def plain_cycles(rows, least, most):
    edge = defaultdict(list)
    for _, a, b, v, t, _ in rows:
        if a is not None and a != b:
            edge[a, b].append((v, t))
    found = {}

    def walk(nodes):
        for a, b in edge:
            if a == nodes[-1]:
                if b == nodes[0] and least <= len(nodes) <= most:
                    steps = [edge[x, y] for x, y in zip(nodes, [*nodes[1:], nodes[0]], strict=True)]
                    values, times = [sum(v for v, _ in s) for s in steps], [t for s in steps for _, t in s]
                    mean = sum(values) / len(values)
                    spread = math.sqrt(sum((x - mean) ** 2 for x in values) / len(values))
                    found[tuple(nodes)] = (round(sum(values), 2), spread / mean < 0.2, (max(times) - min(times)).total_seconds() / 3600)
                elif b > nodes[0] and b not in nodes and len(nodes) < most:
                    walk([*nodes, b])

    for start in {a for a, _ in edge}:
        walk([start])
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_from_halves(spark, seed):
    rows = multigraph(seed)
    got = {tuple(r["nodes"]): (r["total"], r["balanced"], r["hours"]) for r in graph.cycles(frame(spark, rows), 2, 6).collect()}
    assert got == plain_cycles(rows, 2, 6)
    assert {k: v for k, v in got.items() if 3 <= len(k) <= 4} == {tuple(r["nodes"]): (r["total"], r["balanced"], r["hours"]) for r in graph.cycles(frame(spark, rows), 3, 4).collect()}


def test_cycles_of_nothing_and_without_times(spark):
    rows = frame(spark, multigraph(3))
    assert graph.cycles(rows.filter("false"), 2, 4).isEmpty()
    one = graph.circular_flows(graph.cycles(spark.createDataFrame([(1, 2, 5.0), (2, 1, 5.0)], "src long, dst long, value double"), 2, 3)).collect()
    assert [(r["nodes"], r["hours"], r["confidence"], r["risk"]) for r in one] == [([1, 2], None, 0.5, 60.0)]


def test_walks_of_cycles_and_paths_write_nodes_alone_and_not_the_longest(spark):
    rows, kept = frame(spark, multigraph(4)), []

    def cut(df):
        kept.append(df.cache())
        return kept[-1]

    graph.cycles(rows, 2, 5, cut).collect()
    assert [set(df.columns) & {"edges", "more"} for df in kept[1:]] == [set()] * 2  # walks of two edges out and back
    kept.clear()
    found = graph.simple_paths(rows.filter("src <> dst").select("src", "dst").distinct(), 2, 4, cut).collect()
    assert len(kept) == 3 and {len(r["nodes"]) for df in kept[1:] for r in df.collect()} == {3, 4}
    assert len({tuple(r["nodes"]) for r in found}) == len(found) and {r["length"] for r in found} == {2, 3, 4}
    assert all((r["start"], r["end"]) == (r["nodes"][0], r["nodes"][-1]) for r in found)


def plain_trails(rows, least, most, direction, kinds, starts):
    steps = defaultdict(list)
    for i, a, b, _, _, kind in rows:
        if a is not None and (kinds is None or kind in kinds):
            if direction in ("OUT", "BOTH"):
                steps[a].append((i, b))
            if direction == "IN" or direction == "BOTH" and a != b:
                steps[b].append((i, a))
    found = Counter()

    def walk(start, at, edges):
        if len(edges) >= least:
            found[start, at, tuple(edges)] += 1
        if len(edges) < most:
            for i, b in steps[at]:
                if i not in edges:
                    walk(start, b, [*edges, i])

    for start in list(steps):
        if starts is None or start in starts:
            walk(start, start, [])
    return found


@pytest.mark.parametrize(("direction", "kinds", "starts", "least"), [("OUT", None, None, 1), ("IN", ["x", "y"], None, 2), ("BOTH", ["x"], [0, 1], 1), ("BOTH", None, [2], 3)])
def test_trails(spark, direction, kinds, starts, least):
    rows = multigraph(5, 6, 18)
    begin = None if starts is None else spark.createDataFrame([(s,) for s in starts], "node long")
    got = Counter((r["start"], r["end"], tuple(r["edges"])) for r in graph.trails(frame(spark, rows), "id", least, 3, direction, kinds, begin).collect())
    assert got == plain_trails(rows, least, 3, direction, kinds, starts)
    with pytest.raises(ValueError, match="direction"):
        graph.trails(frame(spark, rows), "id", 1, 2, "UP")


def distances_to(edges, nodes):
    back = defaultdict(set)
    for a, b in edges:
        back[b].add(a)
    out = {}
    for node in nodes:
        seen, queue = {node: 0}, deque([node])
        while queue:
            at = queue.popleft()
            for x in back[at]:
                if x not in seen:
                    seen[x] = seen[at] + 1
                    queue.append(x)
        out[node] = seen
    return out


@pytest.fixture(scope="module")
def sparse(spark):
    rng = random.Random(8)
    edges = {(rng.randrange(700), rng.randrange(700)) for _ in range(1500)}
    edges = {(a, b) for a, b in edges if a != b}
    return edges, spark.createDataFrame([(a, b) for a, b in edges], "src long, dst long").repartition(4)


def test_sketched_closeness_and_lengths_within_the_bound(sparse):
    edges, df = sparse
    nodes = {x for e in edges for x in e}
    into = distances_to(edges, nodes)
    worst = 0.0
    for r in graph.closeness_sketched(df).collect():
        d = into[r["node"]]
        want = (len(d) - 1) ** 2 / (sum(d.values()) * (len(nodes) - 1)) if len(d) > 1 else 0.0
        worst = max(worst, abs(r["closeness"] - want) / max(want, 1e-9) if want else r["closeness"])
    assert worst < 4 * 2 * 1.04 / math.sqrt(2**12)
    row = graph.path_lengths_sketched(df).first()
    total, pairs = sum(sum(d.values()) for d in into.values()), sum(len(d) - 1 for d in into.values())
    assert row["nodes"] == len(nodes) and abs(row["mean_length"] / (total / pairs) - 1) < 0.02 and abs(row["reachable"] / (pairs / len(nodes) / (len(nodes) - 1)) - 1) < 0.02


def test_sampled_betweenness_within_the_bound(spark):
    rng = random.Random(9)
    edges = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(200)})
    df = spark.createDataFrame([e for e in edges if e[0] != e[1]], "src long, dst long")
    exact = {r["node"]: r["betweenness"] for r in graph.betweenness(df).collect()}
    n, k = len(exact), 30
    some = {r["node"]: r["betweenness"] for r in graph.betweenness(df, sources=k).collect()}
    bound = math.sqrt(math.log(2 * n / 0.001) / (2 * k)) * n / (n - 1)
    assert some.keys() == exact.keys() and max(abs(some[x] - exact[x]) for x in exact) < bound
    assert sum(some.values()) == pytest.approx(sum(exact.values()), rel=0.4)
    all_of = {r["node"]: r["betweenness"] for r in graph.betweenness(df, sources=1000).collect()}
    assert all(abs(all_of[x] - exact[x]) < 1e-9 for x in exact)


def test_betweenness_in_portions_of_starts(spark):
    rng = random.Random(10)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(110)}
    df = spark.createDataFrame([e for e in edges if e[0] != e[1]], "src long, dst long")
    whole, parts = ({r["node"]: r["betweenness"] for r in graph.betweenness(df, rows=rows).collect()} for rows in (10**6, 500))
    assert max(whole.values()) > 0 and whole == pytest.approx(parts, abs=1e-12)


def test_sketches_of_no_edges(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert graph.closeness_sketched(none).isEmpty() and graph.path_lengths_sketched(none).first()["nodes"] == 0


def test_rapid_paths_of_two_hops_and_four_hours(spark, sf_dir):
    t = spark.createDataFrame([(a, a + 1, START + timedelta(minutes=m), "x") for a, m in enumerate((0, 30, 60, 235))], "src long, dst long, ts timestamp, token string")
    got = sorted((r["start"], r["end"], r["length"], r["micros"] // 60_000_000) for r in graph.rapid_paths(t, 2, 10, 14_400).collect())
    assert got == [(0, 2, 2, 30), (0, 3, 3, 60), (0, 4, 4, 235), (1, 3, 2, 30), (1, 4, 3, 205), (2, 4, 2, 175)]
    assert graph.rapid_paths(t, 2, 1, 60).isEmpty()
    rows = catalog.QUERIES["g06_rapid_paths"](spark, sf_dir.replace("sf0.001", "sf0.01"))
    assert rows.filter("length = 2").count() > 0 and rows.filter("rapid").count() == rows.filter("rapid AND length >= 3").count() < rows.count()


def test_shortest_paths_search_from_the_fewer_ends(spark):
    rng, sizes = random.Random(4), []
    edges = {(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(70)) if a != b}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    best = {1: (1,)}  # of each node the smallest of its shortest paths to 1
    front = [1]
    while front:
        grown = {}
        for v in front:
            for w in near[v] - best.keys():
                grown[w] = min(grown.get(w, (w, *best[v])), (w, *best[v]))
        best |= grown
        front = list(grown)

    def cut(df):
        out = written(df)
        sizes.append(out.count())
        return out

    pairs = spark.createDataFrame([(v, 1) for v in range(40)] + [(None, 1), (3, None)], "start long, end long")
    got = {r["start"]: (r["end"], r["length"], tuple(r["nodes"])) for r in graph.shortest_paths(spark.createDataFrame(list(edges), "src long, dst long"), pairs, 30, cut).collect()}
    assert got == {v: (1, len(p) - 1, p) for v, p in best.items()}
    assert max(sizes) <= 2 * len(edges)  # edges or nodes, not pairs of nodes
