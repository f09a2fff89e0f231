"""Pieces of documents that end at paragraphs, sentences or words, and documents put together from pieces again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Where a piece ends, the best first, and how much of the mark stays with it.
BREAKS = ("\n\n", ". ", " ")


def pieces(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """(start, piece): a piece that isn't the last ends behind the last paragraph in it, else sentence, else word, if that is past its middle."""
    found, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            for mark in BREAKS:
                at = text.rfind(mark, start, end)
                if at > start + size // 2:
                    end = at + len(mark)
                    break
        found.append((start, text[start:end]))
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return found


def chunk_documents(docs: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(id, chunk_index, start, content) for each document; where a piece starts hangs on where the last one ended, so tasks walk through whole texts.

    Null and empty texts have no pieces. Rows are handled alone, repeated ids give repeated pieces; other columns are not read.
    """
    if not 0 <= overlap < size // 2:
        raise ValueError("overlap must be under half of size")
    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("chunk_index", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("content", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                rows = [(i, k, *p) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, p in enumerate(pieces(t or "", size, overlap))]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.schema.field(0).type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.string())], names=[f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def merge_chunks(chunks: DataFrame, score: str) -> DataFrame:
    """(id, content, score): pieces in order with a blank line between, and the best score."""
    g = chunks.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("_c"), F.max(score).alias(score))
    return g.select("id", F.array_join(F.transform("_c", lambda x: x["content"]), "\n\n").alias("content"), score)
