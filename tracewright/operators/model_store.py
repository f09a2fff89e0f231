"""Stored models: one row each in a table of the shared file system, chosen by kind, mode and age; search over parameters."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "model_id string, kind string, mode string, created_at timestamp, figures map<string,double>, body string"
#: Fixed value: the kind that is taken before all others.
ENSEMBLE = "ensemble"


def _path(spark: SparkSession, path: str):  # noqa: ANN202  a Java file system and path
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def save(spark: SparkSession, store: str, model_id: str, kind: str, mode: str, created_at: datetime, figures: dict[str, float], body: str) -> None:
    """A model of the same id is replaced."""
    row = spark.createDataFrame([(model_id, kind, mode, created_at, figures, body)], SCHEMA)
    row.coalesce(1).write.mode("overwrite").parquet(f"{store}/model={model_id}")


def listed(spark: SparkSession, store: str, kind: str | None = None) -> DataFrame:
    """model_id, kind, mode, created_at, figures and body of the stored models; none for a store that isn't there."""
    fs, at = _path(spark, store)
    if not fs.exists(at) or not fs.listStatus(at):
        return spark.createDataFrame([], SCHEMA)
    found = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(store)
    return found if kind is None else found.filter(F.col("kind") == kind)


def delete(spark: SparkSession, store: str, model_id: str) -> bool:
    fs, at = _path(spark, f"{store}/model={model_id}")
    return fs.delete(at, True)


def latest(models: DataFrame, n: int, mode: str | None = None) -> DataFrame:
    """The n newest of a mode (null: any); of one time, the smaller ids."""
    kept = models if mode is None else models.filter(F.col("mode") == mode)
    return kept.orderBy(F.desc("created_at"), "model_id").limit(n)


def chosen(models: DataFrame, n: int = 3, mode: str | None = None) -> DataFrame:
    """The newest ensemble of the mode; where there is none, the n newest others."""
    ensembles = models.filter(F.col("kind") == ENSEMBLE)
    first = latest(ensembles, 1, mode)
    return first if not first.isEmpty() else latest(models.filter(F.col("kind") != ENSEMBLE), n, mode)


def mean_scores(scores: DataFrame, id_col: str, names: list[str], threshold: float = 0.7) -> DataFrame:
    """id_col, score (the mean of the models' scores that aren't null) and flagged (at least the threshold)."""
    total = sum((F.coalesce(F.col(n), F.lit(0.0)) for n in names), F.lit(0.0))
    count = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
    score = F.when(count > 0, total / count)
    return scores.select(id_col, score.alias("score"), F.coalesce(score >= threshold, F.lit(False)).alias("flagged"))


def group_scores(scores: DataFrame, members: DataFrame, group_col: str, id_col: str) -> DataFrame:
    """group_col, score (mean of the members' scores), n: members without a score count as none."""
    joined = members.join(scores.select(id_col, "score"), id_col)
    return joined.groupBy(group_col).agg(F.avg("score").alias("score"), F.count("score").alias("n"))


def search(grid: dict[str, list[Any]], fit: Callable[..., Any], figure: Callable[[Any], float], least: bool = True) -> list[dict[str, Any]]:
    """Fits every combination of the grid; rows with params (as JSON), figure and rank (1: best; equal figures in the grid's order)."""
    combos: list[dict[str, Any]] = [{}]
    for name, values in grid.items():
        combos = [c | {name: v} for c in combos for v in values]
    found = [{"params": json.dumps(c, sort_keys=True), "figure": float(figure(fit(**c)))} for c in combos]
    order = sorted(range(len(found)), key=lambda i: (found[i]["figure"] if least else -found[i]["figure"], i))
    for rank, i in enumerate(order, 1):
        found[i]["rank"] = rank
    return found
