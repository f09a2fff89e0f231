"""Exact quantiles and ranks without a task that holds a key: values are counted, dealt out by range, and counts are summed in two levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.lineage import written


def counted(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n, before, total): each distinct value of a key that isn't null, how often it comes, how many rows are smaller, and the key's rows.

    Rows are counted first, so equal values are one row from there on. Distinct values go to parts by range of (key, value); a
    window runs inside each part alone, and what lies before a part comes from the sums of the parts, one row for each
    key and part. Keys that are null form a group of their own.
    """
    n = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    parts = written(n.repartitionByRange(key, value).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy(key, "_part").agg(F.sum("n").alias("_in"))
    by_key = Window.partitionBy(key)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_in").over(by_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.withColumn("total", F.sum("_in").over(by_key)).select(F.col(key).alias("_key_of_part"), F.col("_part").alias("_number_of_part"), "_before", "total")
    inside = F.coalesce(F.sum("n").over(Window.partitionBy(key, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    done = parts.withColumn("_inside", inside).join(sums, F.col(key).eqNullSafe(F.col("_key_of_part")) & (F.col("_part") == F.col("_number_of_part")))
    return done.select(key, value, "n", (F.col("_before") + F.col("_inside")).alias("before"), "total")


def at_rank(value: str, rank: Column) -> Column:
    """An aggregate over a key's rows of counted(): the value at a rank (from 0)."""
    return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col(value)))


def quantiles(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, the names of shares): quantiles between 0 and 1 of each key, interpolated between neighbours."""
    found = []
    for name, share in shares.items():
        place = (F.col("total") - 1) * F.lit(float(share))
        low = F.floor(place)
        found += [at_rank(value, low).alias(f"_{name}_lo"), at_rank(value, F.least(low + 1, F.col("total") - 1)).alias(f"_{name}_hi"), F.max(place - low).alias(f"_{name}_w")]
    g = counted(df, key, value).groupBy(key).agg(*found)
    mixed = [(F.col(f"_{n}_lo") + F.col(f"_{n}_w") * (F.col(f"_{n}_hi") - F.col(f"_{n}_lo"))).alias(n) for n in shares]
    return g.select(key, *mixed)


def at_index(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, the names of shares): the value at index floor(n * share) of the sorted values, the last at most."""
    ranks = {name: F.least(F.floor(F.col("total") * F.lit(float(share))), F.col("total") - 1) for name, share in shares.items()}
    return counted(df, key, value).groupBy(key).agg(*[at_rank(value, r).alias(name) for name, r in ranks.items()])
