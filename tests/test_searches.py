"""Searches from many starts: paths of any length, long lists of edges, counts beyond floats, as plain Python finds them."""

import random
from collections import deque

import numpy as np
import pytest

from tracewright.operators import graph, searches


def plain(n, edges, starts):
    """By node: hops from the starts, starts that reach it, dependencies (Brandes)."""
    out = [sorted({b for a, b in edges if a == v}) for v in range(n)]
    hops, reached, given = [0] * n, [0] * n, [0.0] * n
    for s in starts:
        dist, paths, order, queue = {s: 0}, [0] * n, [], deque([s])
        paths[s] = 1
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in out[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        share = [0.0] * n
        for v in reversed(order):
            share[v] = sum(paths[v] / paths[w] * (1 + share[w]) for w in out[v] if dist[w] == dist[v] + 1)
            hops[v] += dist[v]
            reached[v] += 1
            given[v] += share[v] if v != s else 0.0
    return hops, reached, given


def test_paths_longer_than_any_bound(spark):
    n = 130
    chain = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "src long, dst long")
    scale = (n - 1) * (n - 2)
    assert {r["node"]: r["betweenness"] for r in graph.betweenness(chain).collect()} == pytest.approx({i: i * (n - 1 - i) / scale for i in range(n)})
    assert {r["node"]: r["closeness"] for r in graph.closeness(chain).collect()} == pytest.approx({i: i * i / (i * (i + 1) / 2 * (n - 1)) if i else 0.0 for i in range(n)})


@pytest.mark.parametrize(("batch", "block"), [(1, 65_536), (5, 64), (8, 256), (300, 4096)])
def test_long_lists_and_odd_batches(monkeypatch, batch, block):
    monkeypatch.setattr(searches, "BLOCK", block)
    rng, n = random.Random(3), 300
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(400)} | {(v, 7) for v in range(100)} | {(7, v) for v in range(50, 150)} | {(9, v) for v in range(200, 260)}
    src, dst = (np.array(x, np.int32) for x in zip(*sorted(e for e in edges if e[0] != e[1]), strict=True))
    into, out_of, starts = searches.Lists(dst, src, n), searches.Lists(src, dst, n), np.arange(0, n, 2)
    hops, reached, given = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    for k in range(0, len(starts), batch):
        searches._hops(into, out_of, n, starts[k : k + batch], hops, reached)
        searches._dependencies(into, out_of, n, starts[k : k + batch], given)
    want = plain(n, edges, starts.tolist())
    assert hops.tolist() == want[0] and reached.tolist() == want[1] and given == pytest.approx(want[2])


def test_counts_of_paths_beyond_floats():
    layers, wide = 400, 8  # 8 ** 399 paths
    a, b = np.divmod(np.arange(wide * wide), wide)
    src = np.concatenate([k * wide + a for k in range(layers - 1)])
    dst = np.concatenate([(k + 1) * wide + b for k in range(layers - 1)])
    n = layers * wide
    given = np.zeros(n)
    searches._dependencies(searches.Lists(dst, src, n), searches.Lists(src, dst, n), n, np.array([0, 1, 2]), given)
    assert given == pytest.approx([0.0 if v < wide else 3 * (layers - 1 - v // wide) for v in range(n)])
