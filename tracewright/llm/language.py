"""Language identification with a byte convolutional network, trained in numpy.

Windows of fixed length slide over the UTF-8 bytes of the lower-cased text. Filters of several widths run over
one-hot bytes (so a filter is a row of a table for each byte and offset), the largest response of each filter
in a window goes through a softmax layer, and a document gets the mean of its windows' probabilities, weighted
by their letters. All windows of a text count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tracewright.llm.base import fold_of, table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Bounds of the labelled sample: documents for each language, windows for each of them, languages.
PER_LANGUAGE, PER_DOCUMENT, MAX_LANGUAGES = 1200, 3, 500
LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"


@dataclass
class ByteNetwork:
    """filters: for each width, an array (width, 256, FILTERS) of responses to a byte at an offset."""

    languages: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray


def windows_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All windows, padded with zero bytes, and the number of the text that each comes from. Empty texts have none."""
    raw = [t.lower().encode() for t in texts]
    counts = np.array([-(-len(r) // WINDOW) for r in raw], dtype=np.int64)
    joined = b"".join(r.ljust(n * WINDOW, b"\0") for r, n in zip(raw, counts, strict=True))
    return np.frombuffer(joined, np.uint8).reshape(-1, WINDOW), np.repeat(np.arange(len(raw)), counts)


def responses(x: np.ndarray, table_: np.ndarray) -> np.ndarray:
    """(windows, positions, FILTERS) for the filters of one width."""
    width = len(table_)
    last = x.shape[1] - width + 1
    found = table_[0][x[:, :last]]
    for k in range(1, width):
        found += table_[k][x[:, k : k + last]]
    return found


def pooled(x: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray | None, int]]) -> np.ndarray:
    """The largest responses, with tables for pairs of bytes: two offsets in one step."""
    two = x[:, :-1].astype(np.uint16) * 256 + x[:, 1:]
    out = []
    for first, second, width in pairs:
        last = x.shape[1] - width + 1
        found = first[two[:, :last]]
        if width == 3:
            found += second[x[:, 2:]]
        elif width == 4:
            found += second[two[:, 2:]]
        out.append(found.max(axis=1))
    return np.concatenate(out, axis=1)


def pair_tables(filters: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray | None, int]]:
    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a[:, None, :] + b[None, :, :]).reshape(65536, -1)

    return [(pair(t[0], t[1]), None if len(t) == 2 else t[2] if len(t) == 3 else pair(t[2], t[3]), len(t)) for t in filters]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteNetwork:
    """Adam on the cross entropy; the gradient of a maximum goes to the position that reached it."""
    rng = np.random.default_rng(seed)
    filters = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0] = 0  # the padding
    n, m = len(WIDTHS) * FILTERS, len(languages)
    params = [*filters, np.zeros(n, np.float32), rng.normal(0, 0.2, (n, m)).astype(np.float32), np.zeros(m, np.float32)]
    mean = [np.zeros_like(p) for p in params]
    square = [np.zeros_like(p) for p in params]
    share = np.bincount(y, minlength=m) / max(1, len(y))
    balance = (1 / np.maximum(share * m, 1e-9)).astype(np.float32)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            xb, yb = x[rows], y[rows]
            best, places = [], []
            for f in params[: len(WIDTHS)]:
                r = responses(xb, f)
                place = r.argmax(axis=1)
                places.append(place)
                best.append(np.take_along_axis(r, place[:, None, :], 1)[:, 0])
            pre = np.concatenate(best, axis=1) + params[-3]
            hidden = np.maximum(pre, 0)
            p = softmax(hidden @ params[-2] + params[-1])
            p[np.arange(len(yb)), yb] -= 1
            p *= balance[yb][:, None] / len(yb)
            back = (p @ params[-2].T) * (pre > 0)
            grads = []
            for k, w in enumerate(WIDTHS):
                g = np.zeros_like(params[k])
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    bytes_ = np.take_along_axis(xb, places[k] + j, 1)
                    np.add.at(g[j], (bytes_, np.arange(FILTERS)[None, :]), part)
                g[:, 0] = 0
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
            step += 1
            for i, g in enumerate(grads):
                mean[i] += 0.1 * (g - mean[i])
                square[i] += 0.001 * (g * g - square[i])
                params[i] -= rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-7)
    return ByteNetwork(languages, params[: len(WIDTHS)], params[-3], params[-2], params[-1])


def fit_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", seed: int = 7) -> ByteNetwork | None:
    """Fits on a bounded sample of the labelled rows: about PER_LANGUAGE texts of each language, PER_DOCUMENT windows of each.

    Rows with a null language, or a text that is null or without letters, teach nothing; without any others there is no network.
    More than MAX_LANGUAGES languages are an error. The sample depends on texts alone, so reruns agree.
    """
    known = docs.select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).filter(F.col("_lang").isNotNull() & F.col("_text").rlike(r"\p{L}"))
    counts = known.groupBy("_lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return None
    languages = sorted(r["_lang"] for r in counts)
    draw: Column = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_text"), 11) / F.lit(float(1 << 53))
    odds = F.create_map(*[F.lit(v) for r in counts for v in (r["_lang"], min(1.0, PER_LANGUAGE / r["count"]))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            out: list[tuple[bytes, str]] = []
            for text, lang in zip(texts, langs, strict=True):
                w, _ = windows_of([text])
                for k in np.unique(np.linspace(0, len(w) - 1, PER_DOCUMENT).astype(int)):
                    out.append((w[k].tobytes(), lang))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], names=["window", "lang"])

    rows = known.filter(draw < odds[F.col("_lang")]).mapInArrow(cut, "window binary, lang string").collect()
    rows = sorted((bytes(r["window"]), r["lang"]) for r in rows)
    x = np.frombuffer(b"".join(r[0] for r in rows), np.uint8).reshape(-1, WINDOW)
    y = np.array([languages.index(r[1]) for r in rows])
    return train(x, y, languages)


def score_texts(network: ByteNetwork, pairs: list, texts: list[str], chunk: int = 192) -> tuple[list[str], list[float]]:
    x, owner = windows_of(texts)
    sums = np.zeros((len(texts), len(network.languages)))
    for at in range(0, len(x), chunk):
        xs = x[at : at + chunk]
        p = softmax(np.maximum(pooled(xs, pairs) + network.bias, 0) @ network.weights + network.offset)
        letters = (((xs >= 97) & (xs <= 122)) | (xs >= 128)).sum(axis=1) + 1e-3
        np.add.at(sums, owner[at : at + chunk], p * letters[:, None])
    total = sums.sum(axis=1)
    best = sums.argmax(axis=1)
    langs, scores = [], []
    for i, text in enumerate(texts):
        if total[i] and LETTER.search(text):
            langs.append(network.languages[best[i]])
            scores.append(float(min(1.0, sums[i, best[i]] / total[i])))
        else:
            langs.append(UNDETERMINED)
            scores.append(0.0)
    return langs, scores


def predict_languages(docs: DataFrame, network: ByteNetwork | None, text_col: str = "text") -> DataFrame:
    """All columns of docs (a partition at a time, nothing is shuffled) with lang_pred and score.

    Columns of those names are replaced. `und` with score 0 for texts that are null, empty or without a letter, and for all
    texts without a network. Every row is scored by itself, so repeated rows get equal scores.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shipped = docs.sparkSession.sparkContext.broadcast(network)
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shipped.value
        pairs = pair_tables(net.filters) if net else []
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                texts = [t or "" for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
                langs, scores = score_texts(net, pairs, texts) if net else ([UNDETERMINED] * len(texts), [0.0] * len(texts))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return docs.select(*kept).mapInArrow(predict, schema)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold_of("doc_id", 3) == 1
    network = fit_languages(docs.filter(~held | F.col("doc_id").isNull()))
    return predict_languages(docs.select("doc_id", "text"), network).select("doc_id", F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language": op7_language}
ORACLES: dict[str, str] = {}
