"""Byte-level BPE: higher-order functions fold ranked merges over the byte arrays of distinct words.

A word is a match of the split pattern, its bytes written as the characters of the same number. Texts are cut into blocks that
hold their distinct words and, for each text, references to them. Words are dealt out by a hash, each distinct one is folded once,
and its ids go back to the blocks that have it, so that shuffles carry words and ids, never texts.

The fold: all pieces of a word that have a rank, sorted by rank and place, are tried in that order. One is merged where just two
pieces make it up. Ranks come from a literal map, cut into hashed buckets because Spark searches a map from its start. A merge
after which a lower rank could have become possible (see `reopening`) starts the order anew, so any rank file gives the
ids of merging the leftmost pair of lowest rank again and again. Words advance by WINDOW bytes: the window is merged
together with the last pieces before it, and the result stands where the first of these comes out the same; otherwise more
pieces are taken, in the end all. That is exact, for a sequence of pieces is the encoding of its bytes if each two
neighbours are the encoding of theirs. Decoding joins the pieces of the ids.
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tracewright.llm.base import shared_dir, table

#: Buckets of the rank map.
BUCKETS = 1 << 14
#: Bytes by which the fold of a word advances.
WINDOW = 32
#: Pieces before a window that are merged with it, as many as it takes.
TAILS = (2, 8, 64, 1 << 30)
#: Characters of text in a block, after which its task starts another.
BLOCK_CHARS = 24_000_000
#: Parts that the words of a block are dealt to, by a hash of so many characters: words that begin alike compress together.
PARTS, ALIKE = 2048, 5
#: Bytes of ids in a batch that goes back to Spark.
BATCH_BYTES = 4_000_000


def read_ranks(lines: list[bytes]) -> dict[bytes, int]:
    """From the lines of a rank file: base64 of the piece, then its rank."""
    return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines) if piece}


def ranks_at(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return read_ranks(f.read().splitlines())


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def reopening(ranks: dict[bytes, int]) -> frozenset[bytes]:
    """Pieces that, once merged, may be half of a piece of lower rank. Files written by training have none.

    A piece is only ever merged from the two that its own bytes end with when merged alone.
    """
    found = set()
    for piece, rank in ranks.items():
        halves = [piece[i : i + 1] for i in range(len(piece))]
        while len(halves) > 2:
            low, i = min((ranks.get(a + b, len(ranks) << 1), i) for i, (a, b) in enumerate(zip(halves, halves[1:])))
            if low == len(ranks) << 1:
                break
            halves[i : i + 2] = [halves[i] + halves[i + 1]]
        if len(halves) == 2:
            found |= {half for half in halves if ranks[half] > rank}
    return frozenset(found)


@lru_cache(maxsize=2)
def bucketed(path: str) -> tuple[str, bool]:
    """As JSON, an array of BUCKETS maps from pieces to twice their rank, and one more if reopening; and whether any is."""
    ranks = ranks_at(path)
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the ranks lack a byte")
    again = reopening(ranks)
    table_ = pa.table({"piece": pa.array([k.decode("latin-1") for k in ranks], pa.string()), "value": pa.array([2 * v + (k in again) for k, v in ranks.items()], pa.int32())})
    pieces = SparkSession.active().createDataFrame(table_).withColumn("bucket", F.pmod(F.hash("piece"), F.lit(BUCKETS)))
    maps = pieces.groupBy("bucket").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("piece", "value")))).alias("map")).toArrow()  # BUCKETS rows at most
    texts = ["null"] * BUCKETS
    for bucket, text in zip(maps.column("bucket").to_pylist(), maps.column("map").to_pylist(), strict=True):
        texts[bucket] = text
    return f"[{','.join(texts)}]", bool(again)


def rank_literal(path: str) -> Column:
    """The rank map; from_json of a literal becomes a literal."""
    return F.from_json(F.lit(bucketed(path)[0]), "array<map<string,int>>")


def fold_merges(word: Column, literal: Column, again: bool = True) -> Column:
    """The ids of a word (array<int>). again: whether the ranks have reopening pieces; without, one pass over the order is enough."""
    zero, one = F.lit(0), F.lit(1)

    def fold(ranks: Column) -> Column:
        def value(piece: Column) -> Column:
            return F.try_element_at(F.get(ranks, F.pmod(F.hash(piece), F.lit(BUCKETS))), piece)

        def candidates(text: Column, n: Column) -> Column:
            def at(start: Column, size: Column) -> Column:
                return let(value(F.substring(text, start + 1, size)), lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), start.alias("start"), size.alias("size"))))

            every = F.transform(F.sequence(zero, n - 2), lambda start: F.transform(F.sequence(F.lit(2), n - start), lambda size: at(start, size)))
            return F.when(n < 2, F.array().cast("array<struct<value:int,start:int,size:int>>")).otherwise(F.sort_array(F.filter(F.flatten(every), lambda c: c.isNotNull())))

        # marks: a character for each place between bytes, 1 where a piece ends or starts
        def two_pieces(marks: Column, c: Column) -> Column:
            return F.rlike(F.substring(marks, c["start"] + 1, c["size"] + 1), F.lit("^10*10*1$"))

        def joined_up(marks: Column, c: Column) -> Column:
            return F.overlay(marks, F.repeat(F.lit("0"), c["size"] - 1), c["start"] + 2)

        def merge(marks: Column, c: Column) -> Column:
            return F.when(two_pieces(marks, c), joined_up(marks, c)).otherwise(marks)

        def merge_or_stop(state: Column, c: Column) -> Column:
            done = F.struct(joined_up(state["marks"], c).alias("marks"), (c["value"] % 2 == 1).alias("again"))
            return F.when(state["again"], state).when(two_pieces(state["marks"], c), done).otherwise(state)

        def marks(n: Column, ordered: Column) -> Column:
            def once(state: Column, _: Column) -> Column:
                fresh = F.struct(state["marks"].alias("marks"), F.lit(False).alias("again"))
                return F.when(state["again"], F.aggregate(ordered, fresh, merge_or_stop)).otherwise(state)

            apart = F.repeat(F.lit("1"), n + 1)
            if not again:
                return F.aggregate(ordered, apart, merge)
            return F.aggregate(F.sequence(one, n), F.struct(apart.alias("marks"), F.lit(True).alias("again")), once, lambda state: state["marks"])

        def cut(text: Column, n: Column, marked: Column) -> Column:
            bounds = F.filter(F.sequence(zero, n), lambda i: F.substring(marked, i + 1, one) == "1")
            return let(bounds, lambda b: F.zip_with(F.slice(b, one, F.size(b) - 1), F.slice(b, F.lit(2), F.size(b)), lambda i, j: F.substring(text, i + 1, j - i)))

        def pieces(text: Column) -> Column:
            return let(text, lambda t: let(F.length(t), lambda n: let(marks(n, candidates(t, n)), lambda m: cut(t, n, m))))

        def advance(whole: Column) -> Column:
            def step(done: Column, at: Column) -> Column:
                def attempt(found: Column, most: Column) -> Column:
                    def joined(tail: Column) -> Column:
                        stands = lambda new: (F.size(tail) == F.size(done)) | (F.get(new, zero) == F.get(tail, zero))
                        before = F.slice(done, one, F.size(done) - F.size(tail))
                        return let(pieces(F.concat(F.array_join(tail, ""), F.substring(whole, at, F.lit(WINDOW)))), lambda new: F.when(stands(new), F.concat(before, new)))

                    return F.when(found.isNotNull(), found).otherwise(let(F.slice(done, F.greatest(F.size(done) - most + 1, one), most), joined))

                return F.aggregate(F.array(*map(F.lit, TAILS)), F.lit(None).cast("array<string>"), attempt)

            return F.aggregate(F.sequence(one, F.length(whole), F.lit(WINDOW)), F.array().cast("array<string>"), step)

        def ids(parts: Column) -> Column:
            return F.transform(parts, lambda piece: F.shiftright(value(piece), 1))

        latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
        return let(latin, lambda w: let(value(w), lambda known: F.when(known.isNotNull(), F.array(F.shiftright(known, 1))).otherwise(ids(advance(w)))))

    return let(literal, fold)


#: Fixed value: a public pattern whose matches in a run of letters, with a space before and marks behind, are known without a search.
LETTERS_FIRST = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Splitter:
    """Splits texts by the pattern, a run between single spaces at a time where that is the same."""

    def __init__(self, pattern: str) -> None:
        space = r"\p{White_Space}"
        plain = pattern.replace(r"[^\s", rf"[^{space}").replace(r"\s", space).replace(r"\S", r"\P{White_Space}")
        self.words = regex.compile(plain)
        self.odd = regex.compile(rf"(?:^|{space}) | (?:$|{space})")
        self.known = pattern == LETTERS_FIRST

    def runs(self, text: str) -> list[str] | None:
        """The runs after the first, each with a space before it in the text; None where spaces are not single."""
        parts = text.split(" ")
        single = "" not in parts and (text.isprintable() or not self.odd.search(text))  # printable: no white space but the space
        return parts if single else None

    def of_run(self, run: str) -> list[str]:
        """The words of a run and the space before it."""
        if self.known:
            letters = run.rstrip(".,;:!?")
            if letters.isalpha():
                return [" " + letters] if len(letters) == len(run) else [" " + letters, run[len(letters) :]]
        return self.words.findall(" " + run)


@lru_cache(maxsize=2)
def _splitter(pattern: str) -> Splitter:
    return Splitter(pattern)


def pack(numbers: np.ndarray) -> bytes:
    """Compressed uint32 numbers, bytes of equal weight together."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return pa.Codec("zstd", 3).compress(planes, asbytes=True)


def unpack(blob: bytes, n: int) -> np.ndarray:
    planes = pa.decompress(blob, 4 * n, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view("<u4").ravel()


class Block:
    """Texts of a task, their distinct words, and the words of each text as numbers."""

    def __init__(self, split: Splitter) -> None:
        self.split = split
        self.words: dict[str, int] = {}
        self.runs: dict[str, bytes] = {}
        self.texts: list[bytes] = []
        self.rows: list[pa.RecordBatch] = []
        self.chars = 0

    def number(self, words: list[str]) -> bytes:
        return b"".join([self.words.setdefault(w, len(self.words)).to_bytes(4, "little") for w in words])

    def add(self, text: str) -> None:
        self.chars += len(text)
        parts = self.split.runs(text)
        if parts is None:
            self.texts.append(self.number(self.split.words.findall(text)))
            return
        out = list(map(self.runs.get, parts))
        out[0] = self.number(self.split.words.findall(parts[0]))
        if None in out:
            for i, run in enumerate(parts):
                if out[i] is None:
                    found = self.runs.get(run)
                    if found is None:
                        self.runs[run] = found = self.number(self.split.of_run(run))
                    out[i] = found
        self.texts.append(b"".join(out))

    def close(self, number: int, kept: list[str]) -> pa.RecordBatch:
        """One row; its words are in order of part and word, and numbered so."""
        self.runs.clear()
        words = sorted(self.words)
        part = np.fromiter((zlib.crc32(w[:ALIKE].encode()) % PARTS for w in words), np.int32, len(words))
        order = np.argsort(part, kind="stable")
        listed, part = [words[i] for i in order.tolist()], part[order]
        new = np.zeros(len(listed), np.uint32)
        new[np.fromiter(map(self.words.get, listed), np.int64, len(listed))] = np.arange(len(listed), dtype=np.uint32)
        counts = np.array([len(t) // 4 for t in self.texts], np.int32)
        joined = b"".join(self.texts)
        self.texts.clear()
        self.words.clear()
        refs = new[np.frombuffer(joined, "<u4")] if joined else np.zeros(0, np.uint32)
        del joined
        starts = np.flatnonzero(np.diff(part, prepend=-1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array([*starts, len(listed)], pa.int32()), pa.array(listed, pa.string()))
        grouped = pa.StructArray.from_arrays([pa.array(part[starts], pa.int32()), lists], names=["part", "words"])
        rows = pa.Table.from_batches(self.rows).combine_chunks()
        docs = pa.StructArray.from_arrays([*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.columns), pa.array(counts)], names=[*kept, "_words"])
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), one(grouped), one(docs), pa.array([pack(refs)], pa.binary())], names=["block", "words", "docs", "refs"])


def cut_blocks(docs: DataFrame, pattern: str, text_col: str, kept: list[str]) -> DataFrame:
    """(block, words: array of (part, words), docs: array of the kept columns and the number of words, refs), read from the shared folder.

    Written in buckets by block, so that a later join on it moves only what it is joined with.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, made = TaskContext.get().partitionId() << 32, 0
        block = Block(_splitter(pattern))
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                for text in b.column(len(kept)).to_pylist():
                    block.add(text or "")
                block.rows.append(b.select(kept))
                if block.chars >= BLOCK_CHARS:
                    yield block.close(first + made, kept)
                    block, made = Block(block.split), made + 1
        if block.rows:
            yield block.close(first + made, kept)

    fields = [*docs.select(*kept).schema, T.StructField("_words", T.IntegerType())]
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("words", T.ArrayType(T.StructType([T.StructField("part", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType()))]))), T.StructField("docs", T.ArrayType(T.StructType(fields))), T.StructField("refs", T.BinaryType())])
    blocks = docs.select(*kept, F.col(text_col).alias("_text")).mapInArrow(run, schema)
    name = f"blocks_{uuid.uuid4().hex}"
    writer = blocks.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}")
    writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").saveAsTable(name)
    written = spark.table(name)
    written.schema  # resolved before the name goes; the files stay
    spark.sql(f"DROP TABLE {name}")
    return written


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with ids_col (array<int>) and <ids_col>_bytes (the same as little-endian uint32) in place of text_col.

    Null texts are empty and have no ids. Special tokens are ordinary text. Repeated rows get equal ids; columns of the
    two names are replaced. All 256 bytes must have ranks. A word is folded once, however many blocks have it.
    """
    bytes_col = f"{ids_col}_bytes"
    kept = [c for c in docs.columns if c not in (text_col, ids_col, bytes_col)]
    blocks = cut_blocks(docs, pattern, text_col, kept)

    dealt = blocks.select("block", F.inline("words")).repartition("part")
    words = dealt.select("block", "part", F.posexplode("words").alias("place", "word")).groupBy("part", "word").agg(F.collect_list(F.struct("block", "place")).alias("places"))
    folded = words.select("part", "places", fold_merges(F.col("word"), rank_literal(ranks_path), bucketed(ranks_path)[1]).alias("ids"))
    back = folded.select("part", "ids", F.inline("places")).groupBy("block", "part").agg(F.sort_array(F.collect_list(F.struct("place", "ids"))).alias("found"))
    ids = back.select("block", "part", F.transform("found", lambda f: F.size(f["ids"])).alias("sizes"), F.flatten(F.col("found.ids")).alias("ids"))

    fields = [*docs.select(*kept).schema, T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(bytes_col, T.BinaryType())]

    def join(block: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("part").combine_chunks()
        flat = lambda c: np.concatenate([np.zeros(0, np.int32), *(x.flatten().to_numpy(zero_copy_only=False) for x in found.column(c).chunks)])
        sizes, all_ids = flat("sizes").astype(np.int64), flat("ids").astype(np.int32)
        starts = np.cumsum(sizes) - sizes
        out = []
        for listed, blob in zip(block.column("docs").combine_chunks(), block.column("refs").to_pylist(), strict=True):
            rows = listed.values
            counts = rows.field("_words").to_numpy(zero_copy_only=False).astype(np.int64)
            refs = unpack(blob, int(counts.sum())).astype(np.int64)
            ends = np.cumsum(counts)
            tokens = np.concatenate(([0], np.cumsum(sizes[refs])))[np.concatenate(([0], ends))]  # where the ids of each text start
            at = 0
            while at < len(rows):
                to = max(at + 1, int(np.searchsorted(tokens, tokens[at] + BATCH_BYTES // 4, "right")) - 1)
                r = refs[ends[at] - counts[at] : ends[to - 1]]
                many = sizes[r]
                total = int(many.sum())
                mine = all_ids[np.repeat(starts[r] - np.cumsum(many) + many, many) + np.arange(total)] if total else np.zeros(0, np.int32)
                bounds = tokens[at : to + 1] - tokens[at]
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(mine, pa.int32()))
                raw = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(mine.astype("<i4"))])
                part = rows.slice(at, to - at)
                out.append(pa.Table.from_arrays([*(part.field(c) for c in kept), lists, raw], names=[*kept, ids_col, bytes_col]))
                at = to
        return pa.concat_tables(out)

    return blocks.select("block", "docs", "refs").groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(join, T.StructType(fields))


@lru_cache(maxsize=2)
def listed_pieces(path: str) -> str:
    """As JSON, the pieces in order of rank; null where a rank has none."""
    pieces = {rank: piece.decode("latin-1") for piece, rank in ranks_at(path).items()}
    return json.dumps([pieces.get(i) for i in range(max(pieces) + 1)])


def decode_documents(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """encoded with text_col (binary): the pieces of the ids, one after the other. Null ids decode to null.

    Pieces are joined as characters of the same number as their bytes, and become bytes in the end.
    """
    literal = F.from_json(F.lit(listed_pieces(ranks_path)), "array<string>")
    text = let(literal, lambda known: F.array_join(F.transform(ids_col, lambda i: F.get(known, i)), ""))
    return encoded.withColumn(text_col, F.encode(text, "ISO-8859-1"))


def token_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoding and decoding every text."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = encode_documents(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return decode_documents(encoded, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("ids_bytes", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
ORACLES: dict[str, str] = {}
