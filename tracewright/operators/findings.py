"""Evidence, findings and reviews: searches, summaries, strategies, budgets, timeouts, samples for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def evidence(items: DataFrame, categories: list[str] | None = None, sources: list[str] | None = None, confidence: float = 0.0, tags: list[str] | None = None) -> DataFrame:
    """Items that meet all that is asked; of tags any one is enough. Null confidence meets no bound above 0."""
    if categories:
        items = items.filter(F.col("category").isin(*categories))
    if sources:
        items = items.filter(F.col("source").isin(*sources))
    if confidence > 0:
        items = items.filter(F.col("confidence") >= confidence)
    return items.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else items


def text_search(items: DataFrame, term: str, columns: list[str], tags: str | None = None) -> DataFrame:
    """Items that have the term, whatever its case, in one of the columns or tags."""
    low = F.lit(term.lower())
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), low), F.lit(False))
    if tags:
        hit = hit | F.coalesce(F.exists(tags, lambda t: F.contains(F.lower(t), low)), F.lit(False))
    return items.filter(hit)


def summary(items: DataFrame) -> DataFrame:
    """(category, source, n, confidence): counts and means by category, by source and of all."""
    return items.groupingSets([["category"], ["source"], []], "category", "source").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


def dispatched(entities: DataFrame, strategies: DataFrame) -> DataFrame:
    """(strategy, id): entities of a strategy's kinds, where it is enabled. strategies (a small configuration): strategy, kinds, enabled."""
    on = strategies.filter("enabled").select("strategy", F.explode("kinds").alias("kind"))
    return entities.join(on, "kind").select("strategy", "id")


def budget_alerts(e: DataFrame, key: str, ts: str, cost: Column, budget: float, share: float = 0.8, order: list[str] | None = None) -> DataFrame:
    """(key, day, spent, level): days on which a key spends a share of its budget or all of it.

    Costs are summed as decimals of twelve places, so that a sum right at a limit is the same in any order of rows; days with a cost
    that is no such decimal (not finite, or of over 16 digits before the point) are summed as they come.
    order: columns that tell a key's rows apart. Days that are no such decimals, or so near a limit that a sum of floats could fall on
    either side, are then summed as floats in this order, as SQL over the table does; a window adds them up, so no day is held whole.
    """
    exact = F.expr("try_cast(_cost AS DECIMAL(28, 12))")
    decimal = F.count("_cost") == F.count(exact)
    total = F.when(decimal, F.sum(exact).cast("double")).otherwise(F.sum("_cost"))
    rows = e.withColumns({"_cost": cost, "day": F.to_date(ts)})
    if order is None:
        g = rows.groupBy(key, "day").agg(total.alias("_s"))
    else:
        off = F.count("_cost") * F.sum(F.abs("_cost")) * 2.0**-52  # a sum of floats is off by less
        g = rows.groupBy(key, "day").agg(total.alias("_s"), (~decimal | (F.abs(total - share * budget) <= off) | (F.abs(total - budget) <= off)).alias("_near"))
        same = F.col(key).eqNullSafe(F.col("_key")) & F.col("day").eqNullSafe(F.col("_day"))
        added = F.sum("_cost").over(Window.partitionBy(key, "day").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        near = rows.join(g.filter("_near").select(F.col(key).alias("_key"), F.col("day").alias("_day")), same, "left_semi").select(key, "day", F.struct(*order).alias("_at"), added.alias("_added"))
        g = g.filter("NOT _near").select(key, "day", "_s").unionByName(near.groupBy(key, "day").agg(F.max_by("_added", "_at").alias("_s")))
    g = g.filter(F.col("_s") >= share * budget)
    return g.select(key, "day", F.round("_s", 4).alias("spent"), F.when(F.col("_s") >= budget, "EXCEEDED").otherwise("WARNING").alias("level"))


def timed_out(reviews: DataFrame, anchor: Column, fallback: Column) -> DataFrame:
    """Open reviews whose time is over, with what happens instead (proceed or abort)."""
    return reviews.filter((F.col("status") == "open") & (F.col("timeout_at") < anchor)).withColumn("outcome", F.when(fallback, "proceed").otherwise("abort"))


def alert_lifecycle(alerts: DataFrame, key: str, order: list) -> DataFrame:
    """(key, status, changes): the last status of each alert and how often it changed."""
    before = F.lag("status").over(Window.partitionBy(key).orderBy(*order))
    g = alerts.withColumn("_b", before).groupBy(key).agg(F.max_by("status", F.struct(*order)).alias("status"), F.count_if(F.col("_b").isNotNull() & (F.col("_b") != F.col("status"))).alias("changes"))
    return g


def split_by_hash(df: DataFrame, key: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """df with part: names dealt out in given shares by a seeded hash of the key, so that a key always gets the same part."""
    place = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) / 1e6
    found, upto = F.lit(list(shares)[-1]), 1.0
    for name, share in reversed(list(shares.items())[:-1]):
        upto = sum(v for n, v in shares.items() if list(shares).index(n) <= list(shares).index(name))
        found = F.when(place < upto, name).otherwise(found)
    return df.withColumn("part", found)


def oversampled(df: DataFrame, label: str, features: list[str], key: str, seed: int = 42) -> DataFrame:
    """(label, features, made): the rows, and new ones of rarer labels until all have about as many as the most frequent.

    A new row lies between a row and the next one of its label in a seeded order inside a block of rows (the last and the first
    are neighbours), at a seeded share of the way, so that no label is gathered in one task.
    """
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    most = n.agg(F.max("_n").alias("_most"))
    want = n.crossJoin(F.broadcast(most)).select(label, ((F.col("_most") - F.col("_n")) / F.col("_n")).alias("_extra"))  # one row
    share = lambda k: F.pmod(F.xxhash64(F.col(key), F.lit(k)), F.lit(1_000_000)) / 1e6
    block = F.pmod(F.xxhash64(F.col(key)), F.lit(64))
    order = Window.partitionBy(label, "_block").orderBy(share(seed), key)
    rows = df.join(F.broadcast(want), label).withColumn("_block", block)  # a row for each label
    rows = rows.withColumn("_next", F.coalesce(F.lead(F.struct(*features)).over(order), F.first(F.struct(*features)).over(order)))
    copies = F.floor(F.col("_extra") + share(seed + 1)).cast("int")
    made = rows.filter(copies > 0).withColumn("_k", F.explode(F.sequence(F.lit(1), copies)))
    t = F.pmod(F.xxhash64(F.col(key), F.col("_k"), F.lit(seed)), F.lit(1_000_000)) / 1e6
    new = made.select(label, *[(F.col(f) + t * (F.col("_next")[f] - F.col(f))).alias(f) for f in features], F.lit(True).alias("made"))
    return df.select(label, *[F.col(f).cast("double").alias(f) for f in features], F.lit(False).alias("made")).unionByName(new)


def clustered(df: DataFrame, features: list[str], k: int, seed: int = 42) -> DataFrame:
    """df with cluster: k-means of standardised features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    stages = [VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True), KMeans(featuresCol="_scaled", predictionCol="cluster", k=k, seed=seed)]
    return Pipeline(stages=stages).fit(df).transform(df).drop("_raw", "_scaled")


def cluster_statistics(df: DataFrame, features: list[str], key: str, most: int = 10) -> DataFrame:
    """(cluster, size, pct, means, top): sizes, shares, means of features and the keys of largest first feature."""
    total = df.agg(F.count("*").alias("_all"))
    g = df.groupBy("cluster").agg(F.count("*").alias("size"), *[F.round(F.avg(f), 6).alias(f"{f}_mean") for f in features])
    best = df.withColumn("_r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(features[0]), key))).filter(F.col("_r") <= most)
    top = best.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(key).cast("string").alias("k")))), lambda x: x["k"]), ",").alias("top"))
    return g.join(top, "cluster").crossJoin(F.broadcast(total)).withColumn("pct", F.round(100 * F.col("size") / F.col("_all"), 4)).drop("_all")  # one row


def standardised(df: DataFrame, key: str, numbers: list[str], category: str) -> DataFrame:
    """(key, numbers, category): nulls become the median, numbers lose their mean and are divided by their population deviation; no category is 'missing'."""
    from tracewright.sources.files import fill_medians

    filled = fill_medians(df.select(key, category, *[F.col(c).cast("double").alias(c) for c in numbers]), numbers)
    m = filled.agg(*[F.avg(c).alias(f"_{c}_m") for c in numbers], *[F.stddev_pop(c).alias(f"_{c}_d") for c in numbers])
    scaled = [F.round(F.coalesce(F.try_divide(F.col(c) - F.col(f"_{c}_m"), F.col(f"_{c}_d")), F.lit(0.0)), 6).alias(c) for c in numbers]
    return filled.crossJoin(F.broadcast(m)).select(key, *scaled, F.coalesce(category, F.lit("missing")).alias(category))  # one row
