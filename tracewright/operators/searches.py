"""Breadth-first searches from many starts over one graph: sums by node over all starts, in slices of starts.

The exact job has a step for each start and edge, so it is quadratic by nature; a row for each start and node is never made. Every slice
gets the packed edges (about 2 bytes each) and its share of the starts, and a task searches from a batch of starts at once: rows are
nodes, columns the starts of the batch (64 starts a column where bits do). A level reads edges into nodes that some start of the batch
has yet to reach, level by level until none is reached, however far. A task holds the edges (about 40 bytes each, in both
directions) and HELD bytes of rows and columns (one column at least), and gives one row a node; nothing but that is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tracewright.operators import registers

#: Slices at least; bytes of rows and columns of a task; columns of numbers and of bits at most; numbers of a block of rows, which stay near the core.
SLICES, HELD, COLUMNS, WORDS, BLOCK = 32, 256_000_000, 16, 64, 65_536
#: Counts of paths are divided by their largest above this, level by level.
LARGE = 2.0**500


class Lists:
    """The nodes at the other end of each node's edges, also laid out for blocks of rows: of each block the first ends, then the second ones, ..."""

    def __init__(self, own: np.ndarray, other: np.ndarray, n: int):
        self.length = np.bincount(own, minlength=n)
        self.first = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.other = other[np.argsort(own, kind="stable")].astype(np.int64)
        self.blocks: dict[int, list] = {}

    def beside(self, rows: np.ndarray) -> np.ndarray:
        """Whether a node is in a list of these; all are taken to be where the lists are long."""
        n = len(self.length)
        lengths = self.length[rows]
        total = int(lengths.sum())
        if total > n:
            return np.ones(n, bool)
        near = np.zeros(n, bool)
        near[self.other[np.repeat(self.first[rows] - np.cumsum(lengths) + lengths, lengths) + np.arange(total)]] = True
        return near

    def _layout(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[tuple[int, np.ndarray]]]:
        """Of these nodes: the order by length, longest first; for each place in a list the ends there; and what is left of a few long lists."""
        order = np.argsort(-self.length[rows], kind="stable")
        first, length = self.first[rows][order], self.length[rows][order]
        counts = np.searchsorted(-length, -np.arange(int(length[0]) if len(rows) else 0))  # of lists longer than 0, 1, ...
        cut = next((j for j in range(16, len(counts)) if counts[j] < 16), len(counts))
        rest = [(i, self.other[first[i] + cut : first[i] + length[i]]) for i in range(counts[cut])] if cut < len(counts) else []
        return order, [self.other[first[:m] + j] for j, m in enumerate(counts[:cut])], rest

    def gathered(self, wanted: np.ndarray, x: np.ndarray, op: np.ufunc) -> Iterator[tuple[slice | np.ndarray, np.ndarray]]:
        """Nodes, some at a time, with op over the rows of x of their lists, in order: those wanted (a mask), or all if most are."""
        n, size = len(wanted), max(1, BLOCK // x.shape[1])
        rows = np.flatnonzero(wanted)
        if 2 * len(rows) >= n:
            if size not in self.blocks:
                self.blocks = {size: [self._layout(np.arange(at, min(at + size, n))) for at in range(0, n, size)]}
            some = ((slice(at, min(at + size, n)), layout) for at, layout in zip(range(0, n, size), self.blocks[size], strict=True))
        else:
            some = ((rows[at : at + size], self._layout(rows[at : at + size])) for at in range(0, len(rows), size))
        spare = np.empty((size, x.shape[1]), x.dtype)
        for which, (order, places, rest) in some:
            out = np.zeros((len(order), x.shape[1]), x.dtype)
            for ends in places:
                m = len(ends)
                np.take(x, ends, axis=0, out=spare[:m], mode="clip")
                op(out[:m], spare[:m], out=out[:m])
            for i, ends in rest:
                for at in range(0, len(ends), size):
                    out[i] = op(out[i], op.reduce(x[ends[at : at + size]], axis=0))
            back = np.empty_like(out)
            back[order] = out
            yield which, back


def _counted(there: np.ndarray) -> np.ndarray:
    """How many are true in each row."""
    return np.bitwise_count(there.view(np.uint64)).sum(axis=1, dtype=np.int64) if there.shape[1] % 8 == 0 else there.sum(axis=1)


def _hops(into: Lists, out_of: Lists, n: int, starts: np.ndarray, sums: np.ndarray, reached: np.ndarray) -> None:
    """Adds to sums and reached, by node, the hops from the starts that reach it, and their number. A start is a bit."""
    w = -(-len(starts) // 64)
    at = np.arange(len(starts))
    bit = np.uint64(1) << (at % 64).astype(np.uint64)
    seen, front, after, every = *(np.zeros((n, w), np.uint64) for _ in range(3)), np.zeros(w, np.uint64)
    np.bitwise_or.at(every, at // 64, bit)
    front[starts, at // 64] = bit  # starts differ
    seen |= front
    reached[starts] += 1
    left, rows, k = np.ones(n, bool), starts, 0
    while len(rows):
        k += 1
        grown = np.zeros(n, bool)
        for some, new in into.gathered(out_of.beside(rows) & left, front, np.bitwise_or):
            new &= ~seen[some]
            count = np.bitwise_count(new).sum(axis=1, dtype=np.int64)
            after[some] = new
            seen[some] |= new
            left[some] = (seen[some] != every).any(axis=1)
            sums[some] += k * count
            reached[some] += count
            grown[some] = count > 0
        front[rows] = 0
        front, after, rows = after, front, np.flatnonzero(grown)


def _dependencies(into: Lists, out_of: Lists, n: int, starts: np.ndarray, sums: np.ndarray) -> None:
    """Adds to sums, by node, the dependencies of the starts on it: paths are counted level by level, and shares go back."""
    w, column = len(starts), np.arange(len(starts))
    paths, x, after, given = (np.zeros((n, w)) for _ in range(4))
    level, left = np.full((n, w), -1, np.int32), np.full(n, w)
    paths[starts, column] = x[starts, column] = 1
    level[starts, column] = 0
    left[starts] -= 1
    levels = [(starts.astype(np.int32), None)]  # nodes that a level has, and what its counts were divided by
    while True:
        k, rows, grown, large = len(levels), levels[-1][0], np.zeros(n, bool), False
        for some, new in into.gathered(out_of.beside(rows) & (left > 0), x, np.add):
            new *= level[some] < 0
            there = new > 0
            count = _counted(there)
            grown[some] = count > 0
            left[some] -= count
            level[some] += there * np.int32(k + 1)
            paths[some] += new
            after[some] = new
            large |= new.max() > LARGE
        x[rows] = 0
        x, after, rows, by = after, x, np.flatnonzero(grown).astype(np.int32), None
        if not len(rows):
            break
        if large:
            by = x.max(axis=0)
            by[by <= LARGE] = 1.0
            there = level[rows] == k
            x[rows] = np.where(there, np.maximum(x[rows] / by, np.finfo(float).tiny), 0.0)
            paths[rows] = np.where(there, x[rows], paths[rows])
        levels.append((rows, by))
    for k in range(len(levels) - 1, 0, -1):
        (rows, by), before = levels[k], np.zeros(n, bool)
        before[levels[k - 1][0]] = True
        for at in range(0, len(rows), BLOCK // w + 1):
            some = rows[at : at + BLOCK // w + 1]
            x[some] = np.divide(1 + given[some], paths[some], out=np.zeros((len(some), w)), where=level[some] == k)
        for some, share in out_of.gathered(into.beside(rows) & before, x, np.add):
            share *= paths[some]
            share *= level[some] == k - 1
            given[some] += share if by is None else share / by
        x[rows] = 0
    given[starts, column] = 0
    sums += given.sum(axis=1)


def _summed(edges: DataFrame, starts: DataFrame, nodes: int, batch: int, least: int, names: list[str], kind: str, search: Callable[..., None]) -> DataFrame:
    """(ordinal, names): sums over all starts (ordinal) of what search adds up by node, `batch` starts at once. A slice has about `least` starts or more. edges: src, dst; ordinals."""
    slices = max(1, min(-(-starts.count() // least), max(SLICES, 3 * edges.sparkSession.sparkContext.defaultParallelism)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends, begin = [], []
        for part in parts:
            packed = part["kind"] == 1
            ends += [registers._edges(data).astype(np.int32) for data in part["data"][packed]]
            begin.append(part["at"][~packed].to_numpy())
        begin = np.concatenate([*begin, np.zeros(0, np.int64)])
        if len(begin):
            dst, src = np.concatenate([*ends, np.zeros((2, 0), np.int32)], axis=1)
            del ends
            into, out_of, sums = Lists(dst, src, nodes), Lists(src, dst, nodes), [np.zeros(nodes, kind) for _ in names]
            for k in range(0, len(begin), batch):
                search(into, out_of, nodes, begin[k : k + batch], *sums)
            for at in range(0, nodes, registers.CHUNK):
                some = slice(at, at + registers.CHUNK)
                yield pd.DataFrame({"ordinal": np.arange(nodes)[some], **{name: values[some] for name, values in zip(names, sums, strict=True)}})

    each = edges.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "kind", "at", "data")
    dealt = starts.select(F.pmod("ordinal", F.lit(slices)).cast("int").alias("slice"), F.lit(2).alias("kind"), F.col("ordinal").alias("at"), F.lit(None).cast("binary").alias("data"))
    rows = each.unionByName(dealt).repartitionById(slices, "slice").sortWithinPartitions("kind", "at")
    typed = {"int64": "long", "float64": "double"}[kind]
    return rows.mapInPandas(run, ", ".join(["ordinal long", *[f"{name} {typed}" for name in names]])).groupBy("ordinal").agg(*[F.sum(name).alias(name) for name in names])


def hops(edges: DataFrame, starts: DataFrame, nodes: int, pairs: int | None = None) -> DataFrame:
    """(ordinal, hops, reached): of each node the hops of the shortest paths from all starts that reach it, added up, and the number of those starts.

    edges: packed, see registers.packed(). starts: ordinal, each once. pairs: of a start and a node at once, where fewer than HELD allows.
    """
    batch = 64 * max(1, min(WORDS, HELD // (32 * max(1, nodes))))
    return _summed(edges, starts, nodes, max(1, min(batch, (pairs or batch * nodes) // max(1, nodes))), 64, ["hops", "reached"], "int64", _hops)


def dependencies(edges: DataFrame, starts: DataFrame, nodes: int, pairs: int | None = None) -> DataFrame:
    """(ordinal, dependency): of each node the shares of the shortest paths from all starts to other nodes that pass through it, added up. As hops()."""
    batch = max(1, min(COLUMNS, HELD // (48 * max(1, nodes))))
    return _summed(edges, starts, nodes, max(1, min(batch, (pairs or batch * nodes) // max(1, nodes))), COLUMNS, ["dependency"], "float64", _dependencies)
