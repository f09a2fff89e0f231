"""Quality classifier from trusted positives and unlabelled text: non-negative positive-unlabelled risk.

Kiryo et al., "Positive-Unlabeled Learning with Non-Negative Risk Estimator" (2017): with class prior pi the risk is
pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)); where the second part falls below zero, a step goes the other way.
Features describe the whole text: byte shares, pairs of byte classes, repetition of words and lines, length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tracewright.llm.base import fold_of, table

#: Bounds of the training sample, in documents.
MAX_POSITIVE, MAX_UNLABELLED = 6000, 6000
THRESHOLD = 0.3


def _classes() -> np.ndarray:
    """A class for each byte: letters by case, digits, blanks, line ends and sentence marks have their own, so has each other ASCII mark in part."""
    kind = np.full(256, 15, np.uint8)  # bytes of non-ASCII characters
    for b in range(128):
        c = chr(b)
        kind[b] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c == " " else 4 if c == "\n" else 5 if c in ".?" else 6 if c in ",;:" else 7 + b % 8
    return kind


CLASSES = _classes()
N_FEATURES = 256 + 256 + 6


@dataclass
class Classifier:
    """prior: the estimated share of positives among unlabelled texts."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    offset: float
    prior: float


def text_features(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    out = np.zeros(N_FEATURES, np.float32)
    n = len(raw)
    if not n:
        return out
    out[:256] = np.bincount(raw, minlength=256) / n
    kind = CLASSES[raw]
    if n > 1:
        out[256:512] = np.bincount(kind[:-1] * np.uint8(16) + kind[1:], minlength=256) / (n - 1)
    words = text.split()
    lines = text.split("\n")
    w = max(1, len(words))
    again = sum(map(str.__eq__, words, words[1:]))
    out[512:] = (again / w, len(set(words)) / w, len(set(lines)) / len(lines), np.log1p(n), np.log1p(w), n / w / 16)
    return np.sqrt(out)  # evens out rare and common bytes


def positive_unlabelled(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 700, rate: float = 0.03, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and offset that minimise the non-negative risk of the logistic loss with Adam."""
    theta = np.zeros(p.shape[1] + 1, np.float32)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    p, u = (np.c_[x, np.ones(len(x))].astype(np.float32) for x in (p, u))
    for step in range(1, steps + 1):
        zp, zu = np.clip(p @ theta, -30, 30), np.clip(u @ theta, -30, 30)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        slope_p, slope_u = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        below = u.T @ slope_u / len(u) - prior * (p.T @ slope_p) / len(p)
        grad = prior * (p.T @ (slope_p - 1)) / len(p) + below if negative >= 0 else -below
        grad[:-1] += decay * theta[:-1]
        mean += 0.1 * (grad - mean)
        square += 0.001 * (grad * grad - square)
        theta -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives in u: the least ratio of the two score tails, of a classifier that tells p from u.

    Below a threshold t, u has at least prior * (p's share below t) of its rows. Thresholds that leave under a twentieth of p are not used.
    """
    half = np.arange(len(p)) % 2 == 0
    w, b = positive_unlabelled(p[half], u, 0.5)
    sp, su = p[~half] @ w + b, u @ w + b
    ratios = [(su >= t).mean() / max(1e-9, (sp >= t).mean()) for t in np.quantile(sp, np.linspace(0.02, 0.95, 60))]
    return float(np.clip(min(ratios), 0.05, 0.98))


def features_of(df: DataFrame, text_col: str) -> DataFrame:
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_features(t or "").tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["features"])

    return df.select(text_col).mapInArrow(compute, "features binary")


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 11, prior: float | None = None) -> Classifier | None:
    """Fits on at most about MAX_POSITIVE trusted positives and MAX_UNLABELLED other texts, both drawn by a seeded hash of the id.

    A document with several labels is a trusted positive if all are 1. Negative labels only serve to estimate the prior (the
    share of 1 among labelled documents); without any, the score tails give it. Null ids, labels and texts are left out.
    Without positives or without text there is no classifier.
    """
    spark = docs.sparkSession

    def draw(c: str, most: int, n: int) -> Column:
        unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(c)), 11) / F.lit(float(1 << 53))
        return unit < F.lit(min(1.0, most / max(1, n)))

    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"))
    totals = known.agg(F.count("*").alias("n"), F.sum((F.col("_label") == 1).cast("long")).alias("positive")).first()
    n, positive = totals["n"], totals["positive"] or 0
    if not positive:
        return None
    trusted = known.filter((F.col("_label") == 1) & draw("_id", MAX_POSITIVE, positive)).select("_id").limit(2 * MAX_POSITIVE).collect()
    trusted = spark.createDataFrame([(r["_id"],) for r in trusted], known.select("_id").schema)
    usable = docs.filter(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    there = usable.select(id_col).count()

    def matrix(df: DataFrame) -> np.ndarray:
        """In sorted order, so that the sums don't depend on the partitions."""
        rows = sorted(bytes(r[0]) for r in features_of(df, text_col).collect())
        return np.frombuffer(b"".join(rows), np.float32).reshape(-1, N_FEATURES)

    p = matrix(usable.join(F.broadcast(trusted), usable[id_col] == trusted["_id"], "left_semi"))
    u = matrix(usable.filter(draw(id_col, MAX_UNLABELLED, there)))
    if not len(p) or not len(u):
        return None
    mean = u.mean(axis=0)
    scale = u.std(axis=0) + 1e-3
    p, u = (p - mean) / scale, (u - mean) / scale
    prior = prior or (positive / n if positive < n else estimate_prior(p, u))
    weights, offset = positive_unlabelled(p, u, min(prior, 0.98))
    return Classifier(mean, scale, weights, offset, prior)


def score_quality(docs: DataFrame, model: Classifier | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs with score and predicted (columns of those names are replaced); nothing is shuffled.

    Null texts score as empty ones do. Without a classifier all scores are 0. Repeated rows get equal scores.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
                if m is None:
                    s = np.zeros(len(texts))
                else:
                    x = (np.stack([text_features(t or "") for t in texts]) - m.mean) / m.scale
                    s = 1 / (1 + np.exp(-np.clip(x @ m.weights + m.offset, -30, 30)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=[*b.schema.names, "score", "predicted"])

    return docs.select(*kept).mapInArrow(score, schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    taught = fold_of("doc_id", 5) != 0
    model = fit_quality(docs.filter(taught), labels.filter(taught))
    return score_quality(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op1_quality": op1_quality}
ORACLES: dict[str, str] = {}
