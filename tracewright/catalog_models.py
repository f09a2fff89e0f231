"""Supervised models over documents with labels: ensembles of trees, importance, contributions, evaluation, stored models, search."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewright.lineage import shared_folder, written
from tracewright.operators import evaluation, model_store, trees
from tracewright.registry import query
from tracewright.views import table

FEATURES = ["length", "words", "word_length", "digits", "capitals", "marks", "lines", "odd"]


def document_features(s: SparkSession, d: str) -> DataFrame:
    """doc_id, the features of whole texts, quality (null for documents without a label) and held_out; null texts have null features."""
    text, n = F.col("text"), F.length("text")
    share = lambda pattern: F.when(n > 0, F.regexp_count(text, F.lit(pattern)) / n)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    docs = table(s, d, "documents").join(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return docs.select(
        "doc_id", n.cast("double").alias("length"), words.cast("double").alias("words"), F.when(words > 0, n / words).alias("word_length"), share("[0-9]").alias("digits"), share("[A-Z]").alias("capitals"),
        share(r"[!-/:-@\[-`{-~]").alias("marks"), F.regexp_count(text, F.lit("\n")).cast("double").alias("lines"), share(r"[^\x00-\x7F]").alias("odd"), "quality", (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0).alias("held_out"),
    )


def _weight(rows: DataFrame) -> Column:
    return F.when(F.col("quality") == 1, trees.class_weight(rows, F.col("quality"))).otherwise(1.0)


def fitted(rows: DataFrame) -> dict[str, trees.Model]:
    """A forest and a boosting model of the labelled rows that aren't held out; both classes weigh the same."""
    known = rows.filter("quality IS NOT NULL AND NOT held_out")
    learn, cuts = trees.prepared(known, "doc_id", FEATURES, F.col("quality"), _weight(known)), trees.cuts_of(known, FEATURES)
    return {"forest": trees.fit_forest(learn, FEATURES, cuts, 12, 4), "boosting": trees.fit_boosting(learn, FEATURES, cuts, 8, 3)}


@query("m07_tree_ensembles", None)
def tree_ensembles(s: SparkSession, d: str) -> DataFrame:
    rows = written(document_features(s, d))
    return trees.scored(rows, "doc_id", fitted(rows)).join(rows.select("doc_id", "held_out", "quality"), "doc_id")


@query("m08_importance", None)
def importance(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame(sorted(trees.importances(fitted(written(document_features(s, d)))).items()), "feature string, importance double")


@query("m08_risk_factors", None)
def risk_factors(s: SparkSession, d: str) -> DataFrame:
    rows = written(document_features(s, d))
    return trees.risk_factors(rows, "doc_id", fitted(rows))


@query("m09_contributions", None)
def contributions(s: SparkSession, d: str) -> DataFrame:
    """What each feature adds to each document's logit."""
    rows = written(document_features(s, d))
    return trees.explained(rows, "doc_id", fitted(rows)["boosting"])


@query("m10_evaluation", None)
def evaluated(s: SparkSession, d: str) -> DataFrame:
    """Figures of each model on the held-out documents with labels; a model of nothing but the prior is beside them."""
    rows = written(document_features(s, d))
    held = written(trees.scored(rows, "doc_id", fitted(rows)).join(rows.filter("held_out AND quality IS NOT NULL").select("doc_id", "quality"), "doc_id"))
    share = rows.filter("NOT held_out").agg(F.avg("quality").alias("p")).first()["p"]
    held = held.withColumn("prior", F.lit(share))
    return evaluation.figures(held, F.col("quality"), ["forest", "boosting", "vote", "prior"])


def _stored(s: SparkSession, rows: DataFrame) -> str:
    """Four models of different ages, the oldest of which is deleted again."""
    store, models = f"{shared_folder(s)}/models-{uuid.uuid4().hex}", fitted(rows)
    for name, kind, mode, day in (("m0", "boosting", "transaction", 1), ("m1", "forest", "transaction", 2), ("m2", "boosting", "transaction", 3), ("m3", "forest", "entity", 4)):
        model_store.save(s, store, name, kind, mode, datetime(2024, 1, day), {"trees": float(len(models[kind].trees))}, models[kind].json())
    model_store.delete(s, store, "m0")
    return store


@query("k20_m19_models", "SELECT * FROM (VALUES ('m2', 'boosting', 8.0::DOUBLE), ('m1', 'forest', 12.0::DOUBLE)) t(model_id, kind, trees)")
def stored_models(s: SparkSession, d: str) -> DataFrame:
    """The newest models of transactions."""
    store = _stored(s, written(document_features(s, d)))
    return model_store.chosen(model_store.listed(s, store), 3, "transaction").select("model_id", "kind", F.col("figures")["trees"].alias("trees"))


@query("m11_ensemble_scores", None)
def ensemble_scores(s: SparkSession, d: str) -> DataFrame:
    """Each document's mean score by the stored models, and each source's mean over its documents."""
    rows = written(document_features(s, d))
    held = model_store.chosen(model_store.listed(s, _stored(s, rows)), 3, "transaction").select("model_id", "body").collect()  # three at most
    models = {r["model_id"]: trees.Model.of(r["body"]) for r in held}
    one = written(model_store.mean_scores(trees.scored(rows, "doc_id", models), "doc_id", list(models)))
    groups = model_store.group_scores(one, table(s, d, "documents").select("doc_id", "source"), "source", "doc_id")
    single = one.select(F.lit("document").alias("level"), F.col("doc_id").cast("string").alias("name"), "score", "flagged")
    return single.unionByName(groups.select(F.lit("source").alias("level"), F.col("source").alias("name"), "score", (F.col("score") >= 0.7).alias("flagged")))


@query("m20_search", None)
def searched(s: SparkSession, d: str) -> DataFrame:
    """Depth and rate by the loss on documents that neither learn nor test."""
    rows = written(document_features(s, d).filter("quality IS NOT NULL AND NOT held_out").withColumn("_valid", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0))
    learn = trees.prepared(rows.filter("NOT _valid"), "doc_id", FEATURES, F.col("quality"))
    cuts = trees.cuts_of(rows.filter("NOT _valid"), FEATURES)
    loss = lambda m: evaluation.figures(trees.scored(rows.filter("_valid"), "doc_id", {"m": m}).join(rows.select("doc_id", "quality"), "doc_id"), F.col("quality"), ["m"]).first()["log_loss"]
    found = model_store.search({"depth": [1, 3], "rate": [0.1, 0.5]}, lambda depth, rate: trees.fit_boosting(learn, FEATURES, cuts, 5, depth, rate), loss)
    return s.createDataFrame([(r["params"], round(r["figure"], 9), r["rank"]) for r in found], "params string, log_loss double, rank int")
