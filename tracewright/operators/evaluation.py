"""Scores of findings and of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewright.lineage import written
from tracewright.operators.quantiles import counted, quantiles


def evidence_quality(confidence: Column, source: Column, raw: Column, provenance: Column, tags: Column) -> Column:
    """.5 and .2 of the confidence, .1 of the source's reliability, .2 of completeness (.4, .4, .2)."""
    reliability = F.when(source == "human", 0.9).when(source == "external", 0.8).when(source.isin("api", "graph"), 0.7).when(source == "system", 0.6).otherwise(0.5)
    complete = 0.4 * raw.cast("double") + 0.4 * provenance.cast("double") + 0.2 * tags.cast("double")
    return F.round(0.5 + 0.2 * confidence + 0.1 * reliability + 0.2 * complete, 6)


def weighted_confidence(items: DataFrame, key: str) -> DataFrame:
    """Mean confidence weighted by quality (0 without any), and the doubt 1 - mean."""
    g = items.groupBy(key).agg(F.sum(F.col("confidence") * F.col("quality")).alias("a"), F.sum("quality").alias("b"), F.avg("confidence").alias("m"), F.count("*").alias("n"))
    return g.select(key, "n", F.round(F.coalesce(F.try_divide("a", "b"), F.lit(0.0)), 6).alias("confidence"), F.round(1 - F.col("m"), 6).alias("uncertainty"))


def confusion(p: DataFrame) -> DataFrame:
    """One row: counts, precision, recall, F1 of predicted against label (0 and 1)."""
    n = lambda a, b: F.sum(((F.col("label") == a) & (F.col("predicted") == b)).cast("long"))
    g = p.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    pr, re = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return g.select("tp", "fp", "fn", "tn", F.round(F.coalesce(pr, F.lit(0.0)), 6).alias("precision"), F.round(F.coalesce(re, F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * pr * re, pr + re), F.lit(0.0)), 6).alias("f1"))


def roc_auc(p: DataFrame) -> DataFrame:
    """Area under the curve from mid-ranks. Scores are counted and ranked in parts by range, so no task orders all of them."""
    one = p.filter(F.col("score").isNotNull()).withColumn("_k", F.lit(0))
    rank = counted(one, "_k", "score").select(F.col("score").alias("_s"), "before", "n")
    pos = one.groupBy("score").agg(F.sum("label").cast("double").alias("pos"))
    ranked = pos.join(rank, F.col("score") == F.col("_s")).agg(F.sum(F.col("pos") * (F.col("before") + (F.col("n") + 1) / 2)).alias("r"), F.sum("pos").alias("p"), F.sum("n").cast("double").alias("n"))
    won = F.col("r") - F.col("p") * (F.col("p") + 1) / 2
    return ranked.select(F.round(F.try_divide(won, F.col("p") * (F.col("n") - F.col("p"))), 6).alias("auc"))


def latency(e: DataFrame, key: str, value: str, failed: Column | None = None) -> DataFrame:
    """Count, mean, least, most, median and percentiles (interpolated) of each key, and the share of rows that failed, if told which."""
    share = [F.round(F.avg(failed.cast("double")), 6).alias("failed_share")] if failed is not None else []
    g = e.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"), F.round(F.min(value), 4).alias("least"), F.round(F.max(value), 4).alias("most"), *share)
    q = quantiles(e, key, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return g.join(q.select(key, *[F.round(c, 4).alias(c) for c in ("p50", "p95", "p99")]), key)


def pattern_risk(found: DataFrame) -> DataFrame:
    """Per entity, from findings (entity, severity, confidence, n): severity-weighted risk over kinds of findings, at most .95."""
    w = F.when(F.col("severity") == "CRITICAL", 1.0).when(F.col("severity") == "HIGH", 0.8).when(F.col("severity") == "MEDIUM", 0.5).otherwise(0.3)
    s = w * F.col("confidence") * F.least("n", F.lit(5)) / 5
    return found.groupBy("entity").agg(F.round(F.least(F.lit(0.95), F.avg(s)), 6).alias("risk"), F.count("*").alias("kinds"))


def figures(rows: DataFrame, label: Column, names: list[str], threshold: float = 0.5) -> DataFrame:
    """One row for each column of scores in `names`: model, n, accuracy, precision, recall, f1, auc and log_loss against a label of 0 or 1.

    auc is the share of pairs of both classes in the right order, equal scores counting half; rows are counted by score first, and
    ranks come from ranges of scores, so no task orders them all. It is null where a class is missing. Rows without label or score go.
    """
    columns = F.array(*[F.struct(F.lit(n).alias("model"), F.col(n).cast("double").alias("p")) for n in names])
    long = rows.withColumn("_y", label.cast("int")).select("_y", F.explode(columns).alias("m")).select("_y", "m.*").filter("_y IS NOT NULL AND p IS NOT NULL")
    long = written(long)
    yes, said = F.col("_y") == 1, F.col("p") >= threshold
    p = F.least(F.greatest("p", F.lit(1e-15)), F.lit(1 - 1e-15))
    counts = long.groupBy("model").agg(
        F.count("*").alias("n"), F.count_if(yes).alias("yes"), F.count_if(yes & said).alias("tp"), F.count_if(~yes & said).alias("fp"), F.avg((yes == said).cast("double")).alias("accuracy"), F.avg(F.when(yes, -F.log(p)).otherwise(-F.log(1 - p))).alias("log_loss")
    )
    ranks = counted(long, "model", "p").select("model", F.col("p"), (F.col("before") + (F.col("n") - 1) / 2).alias("rank"))
    positives = long.filter(yes).groupBy("model", "p").agg(F.count("*").alias("k"))
    summed = positives.join(ranks, ["model", "p"]).groupBy("model").agg(F.sum(F.col("k") * F.col("rank")).alias("ranks"))
    no = F.col("n") - F.col("yes")
    auc = F.when((F.col("yes") > 0) & (no > 0), (F.col("ranks") - F.col("yes") * (F.col("yes") - 1) / 2) / (F.col("yes") * no))
    precision, recall = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0), F.when(F.col("yes") > 0, F.col("tp") / F.col("yes")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return counts.join(summed, "model", "left").select("model", "n", "accuracy", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), auc.alias("auc"), "log_loss")
