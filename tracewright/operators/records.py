"""Small operations on records: bursts, prefixes, term search, drawn edges, labelled loads with statistics, queues, costs, digests, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from tracewright.functions.scalars import micros

#: Fixed value: rows of a result whose reader names no limit.
SAFE_LIMIT = 1_000


def bursts(rows: DataFrame, key: str, ts: str, count: int, seconds: int) -> DataFrame:
    """(key, first, n): keys with at least `count` rows within so many seconds; when their first such run starts, and how many runs start.

    A run is found from the row `count` - 1 places on, so no row meets another. Rows without time are in no run; null is a key as any other.
    """
    order = Window.partitionBy(key).orderBy("_t")
    timed = rows.filter(F.col(ts).isNotNull()).select(key, micros(F.col(ts)).alias("_t"))
    ahead = F.lead("_t", count - 1).over(order) if count > 1 else F.col("_t")
    return timed.withColumn("_a", ahead).filter(F.col("_a") - F.col("_t") <= seconds * 1_000_000).groupBy(key).agg(F.timestamp_micros(F.min("_t")).alias("first"), F.count("*").alias("n"))


def with_prefix(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose text fits a pattern in which * stands for anything; everything else means itself."""
    return rows.filter(F.col(column).like(pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")))


def term_search(rows: DataFrame, term: str, columns: list[str], order: list[str], offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows with the term in one of the columns, in any case, in order; a page of them."""
    hit = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(term.lower())) for c in columns]
    found = rows.filter(F.greatest(*[h.cast("int") for h in hit], F.lit(0)) == 1).orderBy(*order)
    return found.offset(offset).limit(limit if limit is not None else SAFE_LIMIT)


def drawn_edges(edges: DataFrame, label: str) -> DataFrame:
    """from, to, label and arrows, as a drawing wants them."""
    return edges.select(F.col("src").cast("string").alias("from"), F.col("dst").cast("string").alias("to"), F.col(label).cast("string").alias("label"), F.lit("to").alias("arrows"))


def band_colour(probability: Column) -> Column:
    """Red over .7, orange over .4, else green; grey without a probability."""
    return F.when(probability.isNull(), "grey").when(probability > 0.7, "red").when(probability > 0.4, "orange").otherwise("green")


def labelled(nodes: DataFrame, id_col: str, labels: dict[str, list[str]]) -> DataFrame:
    """nodes with scenario: the first label whose list holds the id; the lists are parameters of a few ids."""
    first = [F.when(F.col(id_col).isin(ids), name) for name, ids in labels.items() if ids]
    return nodes.withColumn("scenario", F.coalesce(*first, F.lit(None).cast("string")))


def without_kinds(rows: DataFrame, column: str, kinds: list[str]) -> DataFrame:
    """Rows of other kinds; rows of no kind stay."""
    return rows.filter(~F.coalesce(F.col(column).isin(kinds), F.lit(False)))


def merged_with_statistics(known: DataFrame, rows: DataFrame, key: str, path: str) -> tuple[DataFrame, dict[str, int]]:
    """known with rows put in by key (a row replaces its key's), written to path, and what the write has counted on its way.

    records, created, merged and properties (values that aren't null, but the key) of rows. Keys are unique on either side; null keys are dropped.
    """
    seen = Observation("load")
    columns = rows.columns
    old = known.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.struct(*columns).alias("_old"))
    both = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("_n"), F.struct(*columns).alias("_new")).join(old, F.col("_n") == F.col("_k"), "full")
    new = F.col("_new").isNotNull()
    filled = sum((F.when(F.col("_new")[c].isNotNull(), 1).otherwise(0) for c in columns if c != key), F.lit(0))
    counted = both.observe(seen, F.count_if(new).alias("records"), F.count_if(new & F.col("_old").isNull()).alias("created"), F.count_if(new & F.col("_old").isNotNull()).alias("merged"), F.coalesce(F.sum(filled), F.lit(0)).alias("properties"))
    counted.select(F.coalesce("_new", "_old").alias("_r")).select("_r.*").write.mode("overwrite").parquet(path)
    return known.sparkSession.read.parquet(path), {k: int(v) for k, v in seen.get.items()}


def queues(tasks: DataFrame, queue: str, worker: str, started: Column) -> DataFrame:
    """(queue, waiting, running, workers): tasks that haven't started, that have, and by how many workers."""
    on = F.coalesce(started, F.lit(False))
    return tasks.groupBy(queue).agg(F.count_if(~on).alias("waiting"), F.count_if(on).alias("running"), F.countDistinct(F.when(on, F.col(worker))).alias("workers"))


def costs(calls: DataFrame, endpoint: str, units: Column, prices: dict[str, float]) -> DataFrame:
    """calls with cost: units times the endpoint's price; 0 for endpoints without one, and without units. prices is a parameter of a few rows."""
    table = F.create_map(*[F.lit(x) for pair in prices.items() for x in pair]) if prices else F.create_map().cast("map<string,double>")
    return calls.withColumn("cost", F.round(F.coalesce(F.try_element_at(table, F.col(endpoint)) * units, F.lit(0.0)), 6))


def digest(columns: list[str]) -> Column:
    """md5 of a row's JSON with its fields in order of their names, nulls in it."""
    return F.md5(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).cast("binary"))


def limited(rows: DataFrame, order: list[str], n: int | None = None) -> DataFrame:
    """The first n rows in order; SAFE_LIMIT of them where n isn't given."""
    return rows.orderBy(*order).limit(SAFE_LIMIT if n is None else n)
