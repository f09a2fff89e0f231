"""Chroma audio fingerprints and their alignment.

Sound is cut into overlapping frames; the power of each frame goes to the twelve pitch classes. Filters compare sums of
rectangles in the picture of pitch classes over time, which an integral image gives with four reads each; every filter
gives two bits (as a Gray code), and sixteen filters one packed 32-bit number for each frame. Two recordings are aligned by the
histogram of the offsets at which they have equal numbers, and judged by the share of differing bits at the best offset.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tracewright.llm.base import materialize, table

FRAME, HOP = 1024, 512
LOW_HZ, HIGH_HZ = 60.0, 1800.0
#: Frames that the widest filter looks at.
REACH = 12
#: Equal numbers at one offset that make an alignment, and the share of differing bits up to which it counts.
MIN_HITS, MAX_ERROR = 8, 0.35


@dataclass(frozen=True)
class Filter:
    """kind: which rectangles are compared. first: lowest pitch class. high, wide: the size in classes and frames."""

    kind: int
    first: int
    high: int
    wide: int


#: By rule, so that kinds, places and sizes all vary.
FILTERS = tuple(Filter(k % 5, 5 * k % 12, (4, 6, 8, 12)[k % 4], (4, 6, 8, 12)[k // 4]) for k in range(16))
#: Bounds between the four steps of a filter's value.
STEPS = (-0.22, 0.0, 0.22)
GRAY = np.array([0, 1, 3, 2], np.uint32)


def read_wave(raw: bytes) -> tuple[np.ndarray, int]:
    """Samples from -1 to 1 (channels averaged) and their rate, of 8- or 16-bit PCM."""
    with wave.open(io.BytesIO(raw)) as w:
        data, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if width not in (1, 2):
        raise ValueError(f"{8 * width}-bit samples")
    x = (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128 if width == 1 else np.frombuffer(data, "<i2") / 32768
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1), rate


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """(frames, 12), each frame of length 1 (0 if silent)."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    heard = (hz >= LOW_HZ) & (hz <= HIGH_HZ)
    classes = np.zeros((len(hz), 12))
    classes[np.flatnonzero(heard), np.round(12 * np.log2(hz[heard] / 440)).astype(int) % 12] = 1
    found = np.sqrt(power @ classes)
    length = np.linalg.norm(found, axis=1, keepdims=True)
    return np.divide(found, length, out=np.zeros_like(found), where=length > 1e-6)


def fingerprint(picture: np.ndarray) -> np.ndarray:
    """A number for each frame from which REACH frames follow."""
    n = len(picture) - REACH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(picture) + 1, 25))
    image[1:, 1:] = np.cumsum(np.cumsum(np.tile(picture, 2), axis=0), axis=1)

    def area(f: Filter, t0: float, t1: float, p0: float, p1: float) -> np.ndarray:
        a, b = int(t0 * f.wide), int(t1 * f.wide)
        c, d = f.first + int(p0 * f.high), f.first + int(p1 * f.high)
        return image[b : b + n, d] - image[a : a + n, d] - image[b : b + n, c] + image[a : a + n, c]

    packed = np.zeros(n, np.uint32)
    for f in FILTERS:
        whole = area(f, 0, 1, 0, 1)
        if f.kind == 0:
            part = area(f, 0, 0.5, 0, 1)
        elif f.kind == 1:
            part = area(f, 0, 1, 0, 0.5)
        elif f.kind == 2:
            part = area(f, 0, 0.5, 0, 0.5) + area(f, 0.5, 1, 0.5, 1)
        elif f.kind == 3:
            part = area(f, 0.25, 0.75, 0, 1)
        else:
            part = area(f, 0, 1, 0.25, 0.75)
        step = np.searchsorted(STEPS, np.log((0.05 + part) / (0.05 + whole - part)), side="right")
        packed = packed << np.uint32(2) | GRAY[step]
    return packed


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float] | None:
    """(offset, hits, error) of the offset (place in b minus place in a) with the most equal numbers, the smallest of equals; None without any."""
    order = np.argsort(b, kind="stable")
    left, right = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    many = right - left
    if not many.sum():
        return None
    at = np.repeat(np.arange(len(a)), many)
    other = order[np.repeat(left - np.cumsum(many) + many, many) + np.arange(many.sum())]
    offsets, hits = np.unique(other - at, return_counts=True)
    best = int(offsets[hits == hits.max()][0])
    first, last = max(0, -best), min(len(a), len(b) - best)
    differ = np.bitwise_count(a[first:last] ^ b[first + best : last + best])
    return best, int(hits.max()), float(differ.sum()) / (32 * (last - first))


def fingerprint_media(media: DataFrame, id_col: str, audio_col: str, decode: Callable[[object], tuple[np.ndarray, int]] = read_wave) -> DataFrame:
    """(id, prints, n): prints are little-endian uint32, n their number.

    decode turns a value of audio_col into samples and rate; by default a WAV file. A null, one that can't be decoded, or too short
    a sound has no prints. Rows are handled alone; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b, out = whole.slice(at, 256), []
                for value in b.column(1).to_pylist():
                    try:
                        out.append(fingerprint(chroma(*decode(value))) if value is not None else np.zeros(0, np.uint32))
                    except (ValueError, EOFError, wave.Error):
                        out.append(np.zeros(0, np.uint32))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([o.astype("<u4").tobytes() for o in out], pa.binary()), pa.array([len(o) for o in out], pa.int64())], names=["id", "prints", "n"])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(F.col(id_col).alias("id"), F.col(audio_col).alias("audio")).mapInArrow(run, f"id {kind}, prints binary, n long")


def _values(rows: DataFrame) -> DataFrame:
    """(node, value): the distinct numbers of each recording."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(np.frombuffer(p, "<u4")) for p in b.column(1).to_pylist()]
            nodes = np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(f) for f in found])
            values = np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(values)], names=["node", "value"])

    return rows.select("node", "prints").mapInArrow(run, "node long, value long")


def match_recordings(prints: DataFrame, is_query: Column, min_hits: int = MIN_HITS, max_error: float = MAX_ERROR) -> DataFrame:
    """(query, other, offset, hits, error) between distinct fingerprints, named by node: the smallest id that has them; plus membership.

    Returns the pairs; recordings with equal fingerprints are one node. An alignment takes min_hits equal numbers at one
    offset. Common numbers don't make pairs on their own: of each query, those of its distinct numbers that cover fewer than
    min_hits of its frames, the most common first, are left out of the search, and any alignment still has another one.
    """
    nodes = materialize(prints.filter("n > 0 and id is not null").groupBy("prints", "n").agg(F.min("id").alias("node"), F.max(is_query.cast("int")).alias("asked")), "nodes")
    values = materialize(_values(nodes), "values")
    frames = F.col("frames")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(np.frombuffer(p, "<u4"), return_counts=True) for p in b.column(1).to_pylist()]
            nodes_ = np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(f) for f, _ in found])
            both = [np.concatenate([f[k] for f in found]).astype(np.int64) if found else np.zeros(0, np.int64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes_, pa.int64()), *map(pa.array, both)], names=["node", "value", "frames"])

    asked = nodes.filter("asked = 1").select("node", "prints").mapInArrow(counted, "node long, value long, frames long")
    common = values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    order = Window.partitionBy("node").orderBy(F.desc("df"), "value").rowsBetween(Window.unboundedPreceding, 0)
    searched = asked.join(common, "value").withColumn("covered", F.sum(frames).over(order)).filter(F.col("covered") >= min_hits)
    pairs = searched.select(F.col("node").alias("query"), "value").join(values, "value").filter(F.col("query") != F.col("node")).select("query", F.col("node").alias("other")).distinct()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for q, o, a, z in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                found = align(np.frombuffer(a, "<u4"), np.frombuffer(z, "<u4"))
                if found and found[1] >= min_hits and found[2] <= max_error:
                    out.append((q, o, *found))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["query", "other", "offset", "hits", "error"])

    own = nodes.select("node", "prints")
    both = pairs.join(own.select(F.col("node").alias("query"), F.col("prints").alias("a")), "query").join(own.select(F.col("node").alias("other"), F.col("prints").alias("b")), "other")
    return both.select("query", "other", "a", "b").mapInArrow(judge, "query long, other long, offset long, hits long, error double")


def play_vector(vector: list) -> tuple[np.ndarray, int]:
    """A melody from a vector, for tables without sound: a note of 1/8 s for each component, its pitch the component's size in semitones."""
    rate, note = 4000, HOP
    x = np.array([0.0 if v is None or not np.isfinite(v) else v for v in vector], np.float64)
    hz = 220 * 2 ** (np.clip(np.round(x * 40), -12, 24) / 12)
    t = np.arange(note) / rate
    return np.sin(2 * np.pi * hz[:, None] * t[None, :]).ravel(), rate


def op6_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector, played as a melody: its fingerprint, and for every twentieth what it aligns with."""
    media = table(spark, sf_dir, "embeddings")
    prints = materialize(fingerprint_media(media, "vec_id", "embedding", play_vector), "prints")
    pairs = materialize(match_recordings(prints, F.pmod("id", F.lit(20)) == 0), "aligned")
    sizes = prints.filter("n > 0").groupBy("prints").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    counted = pairs.join(sizes.select(F.col("node").alias("other"), "copies"), "other").groupBy("query").agg(
        F.sum("copies").alias("others"), F.min(F.struct("error", "other", "offset", "hits")).alias("best")
    )
    named = sizes.join(counted.withColumnRenamed("query", "node"), "node", "left")
    rows = prints.select("id", "prints", "n").join(named, "prints", "left")
    asked = F.pmod("id", F.lit(20)) == 0
    return rows.select(
        F.col("id").alias("vec_id"),
        F.col("n").alias("n_prints"),
        F.crc32("prints").alias("prints_crc32"),
        F.when(asked, F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("others", F.lit(0))).alias("n_matches"),
        F.when(asked, F.col("best.other")).alias("best_id"),
        F.when(asked, F.col("best.offset")).alias("best_offset"),
        F.when(asked, F.round("best.error", 6)).alias("best_error"),
    )


QUERIES = {"op6_chroma": op6_chroma}
ORACLES: dict[str, str] = {}
