"""SentencePiece encoding and decoding of merge-type vocabularies.

A text is normalised as its model says (identity with escaped spaces and a leading one), cut where no piece of the vocabulary can
reach across, and each cut is merged from an agenda of adjacent symbol pairs in order of score, equal scores from the left.
Symbols that no piece has become their bytes. Every Arrow batch is checked against the sentencepiece library, which also decodes.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F
from sentencepiece import sentencepiece_model_pb2

from tracewright.llm.base import table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Cuts of at most this many characters are remembered; of those, CACHED that came last and as many that came before them.
SHORT, CACHED = 48, 600_000
#: Characters of the texts that go to the library at once (a longer text goes alone).
PORTION = 1_000_000
#: Cuts that are merged at once.
ROWS = 8192


class Agenda(dict):
    """Ids, packed as little-endian unsigned 32-bit integers, of the cuts of normalised texts."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kind, norm = model.trainer_spec, model.normalizer_spec
        normal, byte = sentencepiece_model_pb2.ModelProto.SentencePiece.NORMAL, sentencepiece_model_pb2.ModelProto.SentencePiece.BYTE
        others = {p.type for p in model.pieces} - {normal, byte, sentencepiece_model_pb2.ModelProto.SentencePiece.UNKNOWN, sentencepiece_model_pb2.ModelProto.SentencePiece.CONTROL}
        if kind.model_type != kind.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or others or kind.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: only merge vocabularies with the identity normalisation and normal, byte and control pieces are known")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        pieces = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == normal}
        ranks = {score: rank for rank, score in enumerate(sorted({score for _, score in pieces.values()}, reverse=True))}
        #: A symbol is the id of its piece; a character that is no piece is its code point above all ids.
        self.n = len(model.pieces)
        self.chars = {p: i for p, (i, _) in pieces.items() if len(p) == 1}
        self.base = self.n + 0x110000
        symbol = {p: i for p, (i, _) in pieces.items()}
        #: Of two neighbours (left * base + right): rank of the score of what they make, and its symbol.
        self.rank, self.made = {}, {}
        for piece, (i, score) in pieces.items():
            for k in range(1, len(piece)):
                left, right = (symbol.get(x, self.n + ord(x) if len(x) == 1 else None) for x in (piece[:k], piece[k:]))
                if left is not None and right is not None:
                    self.rank[left * self.base + right], self.made[left * self.base + right] = ranks[score], i
        self.keys = np.array(sorted(self.rank), np.int64)
        self.ranks = np.array([*map(self.rank.get, self.keys.tolist()), self.n], np.int32)  # the last: of no pair
        self.makes = np.array([*map(self.made.get, self.keys.tolist()), -1], np.int32)
        self.symbol_of = np.arange(0x110000, dtype=np.int32) + self.n
        self.symbol_of[[*map(ord, self.chars)]] = [*self.chars.values()]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == byte} if kind.byte_fallback else {}
        self.unknown = self.library.unk_id()
        begin, end = self.library.bos_id(), self.library.eos_id()
        self.begin, self.end = (np.array([i for i in (x,) if i >= 0], "<u4").tobytes() for x in (begin, end))
        inner = any(SPACE in p.lstrip(SPACE) for p in pieces)
        #: Where spaces only lead pieces, no merge reaches from a character to a space behind it.
        self.cuts = re.compile("(?s).+" if inner else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall

    def learn(self, cuts: set[str]) -> None:
        """Merges the short ones of the cuts that aren't remembered, all at once."""
        if len(self) >= CACHED:
            self.older = dict(self)
            self.clear()
        new = []
        for cut in cuts:
            if (found := self.older.get(cut)) is not None:
                self[cut] = found
            elif len(cut) <= SHORT:
                new.append(cut)
        new.sort(key=len)
        for at in range(0, len(new), ROWS):
            some = new[at : at + ROWS]
            self.update(zip(some, self._merge_rows(some), strict=True))

    def __missing__(self, cut: str) -> bytes:
        """A long cut, or a short one that has not been learned."""
        symbols = self.symbol_of[np.frombuffer(cut.encode("utf-32-le"), "<u4")].tolist()
        self._merge_many(symbols)
        return self._packed(symbols)

    def _packed(self, symbols: list[int]) -> bytes:
        ids = array("I")
        for s in symbols:
            if s < self.n:
                ids.append(s)
            elif self.bytes:
                ids.extend(self.bytes[b] for b in chr(s - self.n).encode())
            else:
                ids.append(self.unknown)
        return ids.tobytes()

    def _places(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where the pairs are in keys; the end for those that make no piece."""
        key = left.astype(np.int64) * self.base + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, len(self.keys)) if len(self.keys) else np.zeros_like(at)

    def _merge_rows(self, cuts: list[str]) -> list[bytes]:
        """A row for each cut: its symbols, and beside them its agenda, a rank for each pair. Each round merges every row's best pair."""
        sizes = np.array([len(c) for c in cuts])
        width = int(sizes.max()) + 1
        symbols = np.full((len(cuts), width), -1, np.int32)
        symbols[np.arange(width) < sizes[:, None]] = self.symbol_of[np.frombuffer("".join(cuts).encode("utf-32-le"), "<u4")]
        agenda = np.full((len(cuts), width), self.n, np.int32)
        pairs = symbols[:, 1:] >= 0
        agenda[:, :-1][pairs] = self.ranks[self._places(symbols[:, :-1][pairs], symbols[:, 1:][pairs])]
        columns, open_rows, left, done = np.arange(width - 1), np.arange(len(cuts)), symbols, agenda
        while len(open_rows):
            at = done.argmin(axis=1)
            more = done[np.arange(len(done)), at] < self.n
            if not more.all():
                symbols[open_rows[~more]] = left[~more]
                open_rows, left, done, at = open_rows[more], left[more], done[more], at[more]
            if not len(open_rows):
                break
            row = np.arange(len(left))
            new = self.makes[self._places(left[row, at], left[row, at + 1])]
            source = columns + (columns > at[:, None])
            left[row, at] = new
            left[:, :-1], done[:, :-1] = np.take_along_axis(left, source, 1), np.take_along_axis(done, source, 1)
            left[:, -1], done[:, -1] = -1, self.n
            after = left[row, at + 1]
            done[row, at] = np.where(after < 0, self.n, self.ranks[self._places(new, np.maximum(after, 0))])
            inner = at > 0
            done[row[inner], at[inner] - 1] = self.ranks[self._places(left[row[inner], at[inner] - 1], new[inner])]
        kept = symbols >= 0
        flat, ends = symbols[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        for i in np.flatnonzero(symbols.max(axis=1) >= self.n).tolist():
            out[i] = self._packed([s for s in symbols[i].tolist() if s >= 0])
        return out

    def _merge_many(self, symbols: list[int]) -> None:
        """The agenda is a heap; the symbols are linked, and one that has been merged into its left neighbour is -1."""
        rank, made, base, n = self.rank, self.made, self.base, len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(rank[key], i, key) for i in range(n - 1) if (key := symbols[i] * base + symbols[i + 1]) in rank]
        heapq.heapify(agenda)
        while agenda:
            _, left, key = heapq.heappop(agenda)
            if symbols[left] < 0 or (right := after[left]) < 0 or symbols[left] * base + symbols[right] != key:
                continue  # one of the two has been merged meanwhile
            symbols[left], symbols[right] = made[key], -1
            after[left] = follower = after[right]
            if follower >= 0:
                before[follower] = left
                if (key := symbols[left] * base + symbols[follower]) in rank:
                    heapq.heappush(agenda, (rank[key], left, key))
            if (leader := before[left]) >= 0 and (key := symbols[leader] * base + symbols[left]) in rank:
                heapq.heappush(agenda, (rank[key], leader, key))
        symbols[:] = [s for s in symbols if s >= 0]

    def encode(self, texts: list[str], ends: bool) -> list[bytes]:
        """Packed ids of each text."""
        listed = [self.cuts(self.prefix + text.replace(" ", SPACE)) if text else [] for text in texts]
        self.learn({cut for cuts in listed for cut in cuts if cut not in self})
        bodies = [b"".join(map(self.__getitem__, cuts)) for cuts in listed]
        return [self.begin + body + self.end for body in bodies] if ends else bodies

    def checked(self, texts: list[str], ends: bool) -> list[tuple[bytes, bool]]:
        """Packed ids of each text, and whether the library gives the same."""
        theirs = self.library.encode(texts, add_bos=ends, add_eos=ends, num_threads=1)
        return [(packed, array("I", ids).tobytes() == packed) for packed, ids in zip(self.encode(texts, ends), theirs, strict=True)]

    def decode(self, packed: list[bytes]) -> list[str]:
        return self.library.decode([array("I", x).tolist() for x in packed], num_threads=1)


@lru_cache(maxsize=2)
def agenda_at(path: str) -> Agenda:
    """One for each worker process and model."""
    return Agenda(path)


def portions(batch: pa.RecordBatch, name: str) -> Iterator[list[str]]:
    """The texts of a batch, null as empty, some at a time."""
    some, size = [], 0
    for x in batch.column(batch.schema.get_field_index(name)):
        text = x.as_py() or ""
        if some and size + len(text) > PORTION:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def _ids(packed: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in packed)])
    if ends[-1] >= 2**31:
        raise ValueError("set spark.sql.execution.arrow.maxRecordsPerBatch lower: a batch has 2**31 ids")
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def encode_documents(docs: DataFrame, path: str, ends: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids (array of int) and agrees (the library gives the same ids) of every whole text, one row for each input row.

    ends: begin and end ids. A null text counts as empty, which has no ids but the ends. Null and repeated ids are rows as any other;
    other columns aren't read, so names that clash do no harm. An empty table gives an empty one.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agenda = agenda_at(path)
        for batch in batches:
            pairs = [pair for texts in portions(batch, "_text") for pair in agenda.checked(texts, ends)]
            packed, same = [p for p, _ in pairs], [s for _, s in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), _ids(packed), pa.array(same, pa.bool_())], names=[id_col, "ids", "agrees"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(encode, f"`{id_col}` {id_type}, ids array<int>, agrees boolean")


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and text: what the library's decode makes of ids_col; null ids give an empty text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agenda = agenda_at(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([agenda.library.decode(x.as_py() or []) for x in batch.column(1)], pa.string())], names=[id_col, "text"])

    id_type = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids")).mapInArrow(decode, f"`{id_col}` {id_type}, text string")


def piece_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_tokens, ids_sha256, decoded_sha256 and agrees of every text: encode_documents and decode_documents in one pass, ids stay in the task."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agenda = agenda_at(path)
        for batch in batches:
            sizes, ids, decoded, same = [], [], [], []
            for texts in portions(batch, "_text"):
                pairs = agenda.checked(texts, True)
                sizes += [len(p) // 4 for p, _ in pairs]
                ids += [hashlib.sha256(p).hexdigest() for p, _ in pairs]
                decoded += [hashlib.sha256(x.encode()).hexdigest() for x in agenda.decode([p for p, _ in pairs])]
                same += [s for _, s in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()), pa.array(same, pa.bool_())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "agrees"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(digest, f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean")


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))


QUERIES = {"op13_pieces": op13_pieces}
#: Merges in order of score have no SQL; tests hold them against the library.
ORACLES: dict[str, str] = {}
