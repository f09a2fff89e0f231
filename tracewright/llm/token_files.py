"""Token ids in wavelet matrix shards: one compressed file answers access, count and occurrence queries.

Documents are encoded with a tokenizer of the tokenizers library, in ascending order of their id, and cut into shards. A shard
holds its ids as a wavelet matrix (Claude, Navarro and Ordonez, "The Wavelet Matrix", 2015): a bit-plane for each bit of
an id, from the highest; each plane orders the sequence for the next, zeros first. Counts of ones before every block of 512
bits make rank a look at one block. The planes, the counts and the documents' bounds are one binary value, written as a row
of a Parquet data set, so that any file system of Spark's holds it and the commit protocol covers lost executors.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tracewright.llm.base import materialize, shared_dir, table

MAGIC = b"TWWM1\n"
BLOCK_BITS = 512
#: A file ends after the document that brings it to so many ids.
SHARD_IDS = 1 << 21
#: Encoded runs of text that a Python worker keeps.
CACHE_WORDS = 1_200_000


class WaveletMatrix:
    """Ids under 2**bits with access, rank and select."""

    def __init__(self, length: int, bits: int, planes: np.ndarray, counts: np.ndarray, zeros: list[int]) -> None:
        """planes: (bits, bytes), most significant bit of a byte first. counts: ones before each block of a plane."""
        self.length, self.bits, self.planes, self.counts, self.zeros = length, bits, planes, counts, zeros

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        bits = max(1, int(ids.max()).bit_length()) if n else 1
        kind = np.uint16 if bits <= 16 else np.uint32
        width = -(-n // BLOCK_BITS) * BLOCK_BITS // 8
        planes, counts, zeros = np.zeros((bits, width), np.uint8), np.zeros((bits, width * 8 // BLOCK_BITS + 1), np.uint32), []
        now = ids.astype(kind)
        for level in range(bits):
            bit = (now >> kind(bits - 1 - level)) & kind(1)
            packed = np.packbits(bit.astype(np.uint8))
            planes[level, : len(packed)] = packed
            counts[level, 1:] = np.cumsum(np.bitwise_count(planes[level]).reshape(-1, BLOCK_BITS // 8).sum(axis=1, dtype=np.uint32))
            ones = bit.astype(bool)
            zeros.append(int(n - ones.sum()))
            now = np.concatenate((now[~ones], now[ones]))
        return cls(n, bits, planes, counts, zeros)

    def _ones_before(self, level: int, at: int) -> int:
        block, rest = divmod(at, BLOCK_BITS)
        first = block * BLOCK_BITS // 8
        inside = self.planes[level, first : first + rest // 8]
        part = int(self.planes[level, first + rest // 8]) >> (8 - rest % 8) if rest % 8 else 0
        return int(self.counts[level, block]) + int(np.bitwise_count(inside).sum()) + part.bit_count()

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.length:
            raise IndexError(at)
        found = 0
        for level in range(self.bits):
            bit = int(self.planes[level, at // 8]) >> (7 - at % 8) & 1
            ones = self._ones_before(level, at)
            at = self.zeros[level] + ones if bit else at - ones
            found = found * 2 + bit
        return found

    def _range(self, value: int, end: int) -> tuple[int, int]:
        start = 0
        for level in range(self.bits):
            a, b = self._ones_before(level, start), self._ones_before(level, end)
            start, end = (self.zeros[level] + a, self.zeros[level] + b) if value >> (self.bits - 1 - level) & 1 else (start - a, end - b)
        return start, end

    def rank(self, value: int, end: int) -> int:
        """How often an id stands before a place."""
        if value < 0 or value >> self.bits:
            return 0
        start, stop = self._range(value, min(max(0, end), self.length))
        return stop - start

    def count(self, value: int) -> int:
        return self.rank(value, self.length)

    def select(self, value: int, number: int) -> int:
        """The place of an occurrence, counted from 0; -1 if there are not so many."""
        if value < 0 or value >> self.bits or number < 0:
            return -1
        start, stop = self._range(value, self.length)
        if start + number >= stop:
            return -1
        at = start + number
        for level in reversed(range(self.bits)):
            at = self._place(level, at - self.zeros[level], True) if value >> (self.bits - 1 - level) & 1 else self._place(level, at, False)
        return at

    def _place(self, level: int, number: int, one: bool) -> int:
        """Where the one (or zero) of a number stands in a plane."""
        before = self.counts[level].astype(np.int64)
        if not one:
            before = np.arange(len(before)) * BLOCK_BITS - before
        block = int(np.searchsorted(before, number, side="right")) - 1
        first = block * BLOCK_BITS // 8
        bits = np.unpackbits(self.planes[level, first : first + BLOCK_BITS // 8])
        return block * BLOCK_BITS + int(np.flatnonzero(bits == one)[number - int(before[block])])

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    def decode(self) -> np.ndarray:
        """All ids, a plane at a time: each plane's stable partition is undone, from the last plane to the first."""
        now = np.zeros(self.length, np.uint16 if self.bits <= 16 else np.uint32)
        for level in reversed(range(self.bits)):
            ones = np.unpackbits(self.planes[level], count=self.length).view(bool)
            before = np.empty_like(now)
            before[~ones] = now[: self.zeros[level]]
            before[ones] = now[self.zeros[level] :] | now.dtype.type(1 << (self.bits - 1 - level))
            now = before
        return now.astype(np.uint32)


def write_shard(ids: np.ndarray, bounds: np.ndarray) -> bytes:
    """bounds: where each document starts, and the end. Layout: magic, length of the header, header, compressed planes, counts and bounds."""
    m = WaveletMatrix.build(ids)
    parts = [zstandard.ZstdCompressor(level=1).compress(x) for x in (m.planes.tobytes(), m.counts.tobytes(), np.diff(bounds, prepend=0).astype(np.uint32).tobytes())]
    header = {"length": m.length, "bits": m.bits, "zeros": m.zeros, "documents": len(bounds) - 1, "sizes": [len(p) for p in parts], "crc32": [zlib.crc32(p) for p in parts]}
    head = json.dumps(header).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(parts)


def read_shard(blob: bytes) -> tuple[WaveletMatrix, np.ndarray]:
    if blob[: len(MAGIC)] != MAGIC:
        raise ValueError("no token shard")
    at = len(MAGIC) + 4
    (size,) = struct.unpack("<I", blob[at - 4 : at])
    header = json.loads(blob[at : at + size])
    at += size
    parts = []
    for length, crc in zip(header["sizes"], header["crc32"], strict=True):
        part = blob[at : at + length]
        if zlib.crc32(part) != crc:
            raise ValueError("a token shard is damaged")
        parts.append(zstandard.ZstdDecompressor().decompress(part))
        at += length
    planes = np.frombuffer(parts[0], np.uint8).reshape(header["bits"], -1)
    counts = np.frombuffer(parts[1], np.uint32).reshape(header["bits"], -1)
    bounds = np.cumsum(np.frombuffer(parts[2], np.uint32).astype(np.int64))
    return WaveletMatrix(header["length"], header["bits"], planes, counts, header["zeros"]), bounds


class WordEncoder:
    """Encodes texts with a tokenizer whose words end in a mark of their own and never cross white space.

    Each distinct run between white space is split into words, and each distinct word encoded, once: many words go to the
    tokenizer as one text, and the end marks part their ids again. Whatever doesn't come back as it went in is encoded by itself.
    added: what is written like a token added to the vocabulary ("<|endoftext|>") becomes its id, as by the library's default;
    such texts are encoded by themselves. Otherwise it is split as ordinary text.
    """

    #: Control characters that Python takes for white space and the tokenizer doesn't.
    ODD = "\x1c\x1d\x1e\x1f"
    MANY = 2000

    def __init__(self, path: str, most: int = CACHE_WORDS, added: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        rules = json.loads(self.tokenizer.to_str())
        suffix = rules["model"]["end_of_word_suffix"]
        self.pattern = regex.compile(rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith(suffix)]] = True
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.most = most
        literals = [(t["content"], t["normalized"]) for t in rules["added_tokens"]] if added else []
        self.raw, self.normal = [c for c, n in literals if not n], [c for c, n in literals if n]
        self.path, self.untouched = path, None

    def _has_added(self, text: str) -> bool:
        if any(c in text for c in self.raw):
            return True
        return bool(self.normal) and any(c in seen for seen in (text, self.tokenizer.normalizer.normalize_str(text)) for c in self.normal)

    def _with_added(self, text: str) -> bytes:
        if self.untouched is None:
            from tokenizers import Tokenizer

            self.untouched = Tokenizer.from_file(self.path)
        return array("I", self.untouched.encode(text, add_special_tokens=False).ids).tobytes()

    def _alone(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def learn_words(self, words: list[str]) -> None:
        groups = [words[at : at + self.MANY] for at in range(0, len(words), self.MANY)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(group) or (len(ids) and stops[-1] != len(ids)):
                self.words.update((w, self._alone(w)) for w in group)
                continue
            raw, last = ids.tobytes(), 0
            for word, stop in zip(group, (4 * stops).tolist(), strict=True):
                self.words[word] = raw[last:stop]
                last = stop

    def learn(self, runs: set[str]) -> None:
        fresh = [r for r in runs if r not in self.runs]
        if len(self.runs) + len(fresh) > self.most:
            self.runs.clear()
            self.words.clear()
            fresh = list(runs)
        if not fresh:
            return
        plain = [r for r in fresh if r.isascii()]
        split = {r: [low] if (low := r.lower()).isalpha() else self.pattern.findall(low) for r in plain}
        if len(plain) < len(fresh):
            others = [r for r in fresh if not r.isascii()]
            normal = self.tokenizer.normalizer.normalize_str("\n".join(others)).split(" ")
            if len(normal) != len(others):
                self.runs.update((r, self._alone(r)) for r in others)
            else:
                split.update(zip(others, map(self.pattern.findall, normal), strict=True))
        self.learn_words([w for w in {w for s in split.values() for w in s} if w not in self.words])
        known = self.words
        for run, parts in split.items():
            self.runs[run] = known[parts[0]] if len(parts) == 1 else b"".join(map(known.__getitem__, parts))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian uint32."""
        own = {i: self._with_added(t) for i, t in enumerate(texts) if self._has_added(t)}
        split = [None if i in own or any(c in t for c in self.ODD) else t.split() for i, t in enumerate(texts)]
        self.learn({r for s in split if s is not None for r in s})
        known = self.runs
        return [own[i] if i in own else self._alone(t) if s is None else b"".join(map(known.__getitem__, s)) for i, (t, s) in enumerate(zip(texts, split, strict=True))]


@lru_cache(maxsize=1)
def _encoder(path: str, added: bool) -> WordEncoder:
    """One for each Python worker, so that later tasks find the words of earlier ones."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path, added=added)


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, bounds: list[int], id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """(part, id, wide, ids): the ids with end_id last, as little-endian uint16 or, if wide, uint32.

    part: how many of bounds are at most the id; -1 for a null id. Null texts are empty and have the end id alone.
    added: see WordEncoder.
    """
    edges = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, added)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                wide, out = [], []
                for raw in encoder.encode([t or "" for t in b.column(1).to_pylist()]):
                    ids = np.append(np.frombuffer(raw, np.uint32), np.uint32(end_id))
                    wide.append(bool(ids.max() >> 16))
                    out.append((ids if wide[-1] else ids.astype(np.uint16)).tobytes())
                parts = [-1 if i is None else int(np.searchsorted(edges, i, side="right")) for i in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), b.column(0), pa.array(wide, pa.bool_()), pa.array(out, pa.binary())], names=["part", "id", "wide", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "part int, id long, wide boolean, ids binary")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS, added: bool = False) -> None:
    """Writes shards under path: rows (part, shard, n_tokens, doc_ids, file), in ascending order of the documents' ids.

    Parts are ranges of ids (whole numbers), in order, from quantiles of the ids alone; a task cuts its parts into shards as their
    rows stream by. Null ids come first; rows with equal ids follow the bytes of their tokens. An empty table writes no shard.
    added: see WordEncoder.
    """
    many = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [k / many for k in range(1, many)], 10 * many)).first()[0]
    encoded = encode_documents(docs, tokenizer, end_id, sorted(set(found or [])), id_col, text_col, added)
    names = ["part", "shard", "n_tokens", "doc_ids", "file"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids: list[int | None] = []
        held: list[np.ndarray] = []
        at, total, shard = None, 0, 0

        def close() -> pa.RecordBatch:
            bounds = np.concatenate(([0], np.cumsum([len(h) for h in held])))
            blob = write_shard(np.concatenate(held), bounds)  # of mixed widths, the wider
            row = [pa.array([at], pa.int32()), pa.array([shard], pa.int32()), pa.array([total], pa.int64()), pa.array([held_ids], pa.list_(pa.int64())), pa.array([blob], pa.binary())]
            return pa.RecordBatch.from_arrays(row, names=names)

        for b in batches:
            for part, id_, wide, ids in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if held and (part != at or total >= shard_ids):
                    yield close()
                    held_ids, held, total, shard = [], [], 0, 0 if part != at else shard + 1
                if part != at:
                    at, shard = part, 0
                held_ids.append(id_)
                held.append(np.frombuffer(ids, np.uint32 if wide else np.uint16))
                total += len(held[-1])
        if held:
            yield close()

    ordered = encoded.repartition("part").sortWithinPartitions("part", "id", "ids")
    ordered.mapInArrow(cut, "part int, shard int, n_tokens long, doc_ids array<long>, file binary").write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, from the shards alone; ids are decoded from the wavelet matrix.

    Starts are sums over shards: within groups of 1024 shards first, then over the groups.
    """
    shards = spark.read.parquet(path)
    sizes = shards.select("part", "shard", "n_tokens")
    group = F.floor(F.col("part") / 64).alias("_group")
    inside = Window.partitionBy("_group").orderBy("part", "shard")
    near = sizes.withColumn("_group", F.floor(F.col("part") / 64)).withColumn("_near", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    groups = sizes.groupBy(group).agg(F.sum("n_tokens").alias("_n")).withColumn("_far", F.sum("_n").over(Window.orderBy("_group")) - F.col("_n"))
    starts = near.join(groups, "_group").select("part", "shard", (F.col("_near") + F.col("_far")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                matrix, bounds = read_shard(b.column(3)[i].as_py())
                ids = matrix.decode().astype("<u4")
                crcs = [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
                doc_ids = b.column(2).slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(crcs), b.column(0)[i].as_py()), pa.int32()), pa.array(np.full(len(crcs), b.column(1)[i].as_py()), pa.int32()), doc_ids, pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64())],
                    names=["part", "shard", "id", "inner", "n_tokens", "ids_crc32"],
                )

    rows = shards.select("part", "shard", "doc_ids", "file").mapInArrow(run, "part int, shard int, id long, inner long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "shard"]).select("id", (F.col("first") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 2, added=True)
    return read_tokens(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


QUERIES = {"op5_token_files": op5_token_files}
ORACLES: dict[str, str] = {}
