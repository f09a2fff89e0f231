"""Upserts as full joins of a table with new rows of the same key.

Keys may be null and then meet each other. A key that comes more than once in the new rows counts once, as the row that is
greatest by its other columns in order; rows of the old table are never multiplied. Columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def once(new: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: the greatest by the other columns, in order."""
    rest = [c for c in new.columns if c not in keys]
    if not rest:
        return new.distinct()
    return new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def _merged(old: DataFrame, new: DataFrame, keys: list[str], value: object) -> DataFrame:
    """value: (old column, new column, whether there is a new row) to the result."""
    o = old.select(F.struct(*[F.col(f"`{c}`") for c in old.columns]).alias("o"))
    n = once(new, keys).select(F.struct(*[F.col(f"`{c}`") for c in new.columns]).alias("n"))
    meet = F.lit(True)
    for k in keys:
        meet = meet & F.col("o")[k].eqNullSafe(F.col("n")[k])
    j = o.join(n, meet, "full_outer")
    there = F.col("n").isNotNull()
    cells: list[Column] = [F.when(there, F.col("n")[c]).otherwise(F.col("o")[c]) if c in keys else value(F.col("o")[c], F.col("n")[c], there) for c in old.columns]
    return j.select(*[cell.alias(c) for cell, c in zip(cells, old.columns, strict=True)])


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of their key; others stay or are added."""
    return _merged(old, new, keys, lambda o, n, there: F.when(there, n).otherwise(o))


def merge_partial(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """As merge, but a null never overwrites a value."""
    return _merged(old, new, keys, lambda o, n, there: F.coalesce(n, o))


def merge_greatest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keeps the greater of old and new in every column."""
    return _merged(old, new, keys, lambda o, n, there: F.greatest(n, o))


def create_unique(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Adds only rows whose key is new."""
    known = old.select(*[F.col(k).alias(f"_known_{k}") for k in keys]).distinct()
    meet = F.lit(True)
    for k in keys:
        meet = meet & F.col(k).eqNullSafe(F.col(f"_known_{k}"))
    return old.unionByName(once(new, keys).join(known, meet, "left_anti").select(*old.columns))


def count_up(old: DataFrame, hits: DataFrame, key: str, counter: str) -> DataFrame:
    """Adds the number of hits to a counter that starts at 0."""
    n = hits.groupBy(key).agg(F.count("*").alias("_hits")).withColumnRenamed(key, "_hit_key")
    j = old.join(n, F.col(key).eqNullSafe(F.col("_hit_key")), "full_outer")
    return j.withColumn(key, F.coalesce(key, "_hit_key")).withColumn(counter, (F.coalesce(counter, F.lit(0)) + F.coalesce("_hits", F.lit(0))).cast("long")).drop("_hits", "_hit_key")


def keep_all(nodes: DataFrame, found: DataFrame, key: str, default: dict[str, object]) -> DataFrame:
    """nodes with the columns of found (one row for each key), and defaults where found has no row."""
    return nodes.join(found, key, "left").fillna(default)
