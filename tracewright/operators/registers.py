"""HyperLogLog registers of all nodes of a graph, merged along edges in slices: a slice holds a few registers of every node.

A sketch is larger than all edges of a node together, so edges go to the slices and sketches go nowhere: a round sends each packed edge
(about 2 bytes) to every slice, whatever the size of a sketch, and a slice's registers are written once. A task streams the edges past the registers of its
slice; slices get narrower as nodes get more, so that a task holds HELD bytes at most (a byte a node at least).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Slices at least, but of graphs of at most so many nodes, which are one slice; bytes of registers that a task holds, before and after a
#: round; nodes whose registers are one row.
SLICES, SMALL, HELD, CHUNK = 32, 1000, 256_000_000, 4096


def slices_of(nodes: int, bits: int) -> tuple[int, int]:
    """Slices, and the registers of one."""
    width = max(1, min(-(-(1 << bits) // (SLICES if nodes > SMALL else 1)), HELD // (2 * max(1, nodes))))
    return -(-(1 << bits) // width), width


def packed(edges: DataFrame) -> DataFrame:
    """(kind 1, at, data): edges (dst, src; ordinals) in order of dst, some thousands to a row."""

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                steps = np.diff(part.to_numpy(np.int64), axis=0, prepend=0).T  # small but for the first
                yield pd.DataFrame({"kind": [1], "at": [int(part["dst"].iloc[0])], "data": [zlib.compress(steps.copy().view(np.uint8).reshape(-1, 8).T.tobytes(), 1)]})

    return edges.select("dst", "src").repartitionByRange("dst", "src").sortWithinPartitions("dst", "src").mapInPandas(pack, "kind int, at long, data binary")


def _edges(data: bytes) -> np.ndarray:
    """dst and src of a packed row."""
    flat = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T.copy().view(np.int64)
    return flat.reshape(2, -1).cumsum(axis=1)


def first(nodes: DataFrame, bits: int, slices: int, width: int) -> DataFrame:
    """(slice, at, data, power, empty, grew): of nodes (ordinal, hash), each with its own register set. CHUNK nodes in a row."""

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        at, h = int(part["ordinal"].min()) // CHUNK * CHUNK, part["hash"].to_numpy().view(np.uint64)
        registers = np.zeros((int(part["ordinal"].max()) - at + 1, slices * width), np.uint8)
        rest = h >> np.uint64(bits)
        rank = 65 - bits - np.frexp(rest.astype(np.float64))[1] if 64 - bits <= 53 else 65 - bits - np.array([int(x).bit_length() for x in rest])
        registers[part["ordinal"].to_numpy() - at, (h & np.uint64((1 << bits) - 1)).astype(np.int64)] = rank
        return pd.DataFrame([_row(s, at, registers[:, s * width : (s + 1) * width], (1 << bits) - s * width, True) for s in range(slices)], columns=COLUMNS)

    return nodes.select("ordinal", "hash").groupBy(F.floor(F.col("ordinal") / CHUNK)).applyInPandas(fill, SCHEMA)


COLUMNS = ["slice", "at", "data", "power", "empty", "grew"]
SCHEMA = "slice int, at long, data binary, power binary, empty binary, grew boolean"


def _row(s: int, at: int, registers: np.ndarray, used: int, grew: bool) -> tuple:
    """power: of each node the sum of 2 ** -register over those that are set; empty: how many aren't. Both sums are exact."""
    registers = np.ascontiguousarray(registers)
    real = registers[:, : max(0, used)]
    powers = np.ldexp(1.0, -np.arange(256))
    powers[0] = 0.0
    return s, at, registers.tobytes(), powers[real].sum(axis=1).tobytes(), (real == 0).sum(axis=1).astype(np.int32).tobytes(), grew


def merged(state: DataFrame, edges: DataFrame, nodes: int, bits: int, slices: int, width: int) -> DataFrame:
    """The state (like first()) one hop on: a node's registers are the largest of its own and those of its sources."""

    def out(s: int, old: np.ndarray, new: np.ndarray) -> Iterator[pd.DataFrame]:
        for at in range(0, nodes, CHUNK):
            mine = new[at : at + CHUNK]
            yield pd.DataFrame([_row(s, at, mine, (1 << bits) - s * width, bool((mine != old[at : at + CHUNK]).any()))], columns=COLUMNS)

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, old, new = None, None, None
        for part in parts:
            for s, kind, at, data in zip(part["slice"].tolist(), part["kind"].tolist(), part["at"].tolist(), part["data"], strict=True):
                if s != current:
                    if current is not None:
                        yield from out(current, old, new)
                    current, old = s, np.zeros((nodes, width), np.uint8)
                    new = np.zeros((nodes, width), np.uint8)
                if kind == 0:
                    old[at : at + len(data) // width] = new[at : at + len(data) // width] = np.frombuffer(data, np.uint8).reshape(-1, width)
                else:
                    dst, src = _edges(data)
                    starts = np.flatnonzero(np.diff(dst, prepend=-1))
                    into = dst[starts]
                    new[into] = np.maximum(new[into], np.maximum.reduceat(old[src], starts, axis=0))
        if current is not None:
            yield from out(current, old, new)

    sent = edges.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "kind", "at", "data")
    rows = state.select("slice", F.lit(0).alias("kind"), "at", "data").unionByName(sent)
    return rows.repartitionByRange(slices, "slice").sortWithinPartitions("slice", "kind", "at").mapInPandas(merge, SCHEMA)


def estimates(state: DataFrame, bits: int) -> DataFrame:
    """(ordinal, n): numbers of distinct nodes by Ertl's estimator, which needs no correction for small or large ones."""
    m = 1 << bits

    def estimate(part: pd.DataFrame) -> pd.DataFrame:
        power = sum(np.frombuffer(x) for x in part["power"])
        x = sum(np.frombuffer(x, np.int32) for x in part["empty"]) / m
        sigma, term, weight = x.copy(), x.copy(), 1.0
        for _ in range(64):
            term = term * term
            sigma, weight = sigma + term * weight, weight * 2
        n = m * m / (2 * np.log(2)) / (m * sigma + power)
        return pd.DataFrame({"ordinal": int(part["at"].iloc[0]) + np.arange(len(n)), "n": np.rint(n).astype(np.int64)})

    return state.select("at", "power", "empty").groupBy("at").applyInPandas(estimate, "ordinal long, n long")


def balls(edges: DataFrame, nodes: DataFrame, count: int, most: int, bits: int, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(ordinal, hops, n) of nodes (ordinal from 0 to count - 1, hash) and edges (src, dst; ordinals), for hops from 0 until no register grows."""
    slices, width = slices_of(count, bits)
    rows, state = cut(packed(edges)), cut(first(nodes, bits, slices, width))
    found = cut(estimates(state, bits)).withColumn("hops", F.lit(0))
    for k in range(1, most + 1):
        state = cut(merged(state, rows, count, bits, slices, width))
        if state.filter("grew").isEmpty():
            break
        found = found.unionByName(cut(estimates(state, bits)).withColumn("hops", F.lit(k)))
    return found.select("ordinal", "hops", "n")
