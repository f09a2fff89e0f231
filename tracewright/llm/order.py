"""Positions within keys without a task for each key: rows are dealt by range, counted by part, and numbered from the counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.llm.base import materialize

#: monotonically_increasing_id holds the number of the part above this many bits.
PART_BITS = 33


def joined(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Joins where all names are equal, null with null; left's columns, then right's others. The two may share their origin."""
    other = right.withColumnsRenamed({n: f"_of_{n}" for n in names})
    on = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"_of_{n}")) for n in names])
    return left.join(other, on, how).drop(*[f"_of_{n}" for n in names])


def numbered(df: DataFrame, keys: list[str], order: list[str], tag: str) -> DataFrame:
    """df with _pos (long): each row's place, from 0, among the rows of its keys in ascending order (nulls first); _n: how many those are.

    Rows equal in all keys and order columns take any order among themselves; a seeded salt spreads them over parts, so that neither
    a frequent key nor a repeated row is one task's work. The sorted rows are written to the shared folder, and the counts of the
    parts decide the rest. df may not have columns named _pos, _at, _part, _salt, _first or _n.
    """
    columns = df.columns
    dealt = df.withColumn("_salt", F.rand(7)).repartitionByRange(*keys, *order, "_salt").sortWithinPartitions(*keys, *order).drop("_salt")
    dealt = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), tag).withColumn("_part", F.shiftright("_at", PART_BITS))
    counts = dealt.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*keys)
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*keys, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_first"), F.sum("_n").over(whole).alias("_n"))
    return joined(dealt, starts, [*keys, "_part"]).select(*columns, (F.col("_at") + F.col("_first")).alias("_pos"), "_n")
