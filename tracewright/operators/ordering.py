"""Order over a whole table without a task that holds it: dense positions, values carried forward, and greedy windows by pointer doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.lineage import written

#: monotonically_increasing_id holds the number of the part above this many bits.
PART_BITS = 33


def in_parts(df: DataFrame, order: list[str]) -> DataFrame:
    """df in the shared folder, dealt by range of `order` and sorted, with _at (ascending with the order) and _part. Equal rows take any order."""
    dealt = df.withColumn("_salt", F.rand(7)).repartitionByRange(*order, "_salt").sortWithinPartitions(*order).drop("_salt")
    return written(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", PART_BITS))


def numbered(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """df with each row's place from 0 in the order (nulls first): places within parts, and how many rows lie in the parts before."""
    parts = in_parts(df, order)
    counts = parts.groupBy("_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # as many rows as parts
    starts = counts.select("_part", (before - F.col("_first")).alias("_by"))
    return parts.join(F.broadcast(starts), "_part").select(*df.columns, (F.col("_at") + F.col("_by")).alias(name))


def carried(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the last value that isn't null at or before each row in the order: within parts by a window, across them from the parts' last ones."""
    parts = in_parts(df.withColumn("_v", value), order)
    inside = F.last("_v", ignorenulls=True).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    ends = parts.groupBy("_part").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_at"))).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # as many rows as parts
    known = ends.select("_part", before.alias("_known"))
    return parts.withColumn("_inside", inside).join(F.broadcast(known), "_part").select(*df.columns, F.coalesce("_inside", "_known").alias(name))


def reached(steps: DataFrame, start: int) -> DataFrame:
    """pos: all places that one comes to from `start` along steps (pos, to; to > pos, each pos once).

    Pointer doubling: after round k the places within 2**k steps are known, and steps are 2**k long. Only places that some step leads to
    take part. Rounds are the logarithm of the number of places reached.
    """
    spark = steps.sparkSession
    hit = steps.select(F.col("to").alias("pos")).distinct().unionByName(spark.createDataFrame([(start,)], "pos long")).distinct()
    steps = written(steps.join(hit, "pos"))
    found, n = spark.createDataFrame([(start,)], "pos long"), 1
    while True:
        more = written(found.unionByName(found.join(steps, "pos").select(F.col("to").alias("pos"))).distinct())
        if (now := more.count()) == n:
            return more
        found, n = more, now
        far = steps.select(F.col("pos").alias("to"), F.col("to").alias("further"))
        steps = written(steps.join(far, "to").select("pos", F.col("further").alias("to")))


def greedy_windows(df: DataFrame, id_col: str, ts: str, seconds: int) -> DataFrame:
    """df with anchor (an id) and its time anchor_ts: the first row opens a window of so many seconds, the first row behind it the next, and so on.

    Rows go by time, equal times by id; a row just at the end is still in the window. Rows without time are in none and go. Where a
    window that some row would open ends is found for all rows at once, from the order of all times and all ends together.
    """
    rows = written(numbered(df.filter(F.col(ts).isNotNull()).withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))), ["_us", id_col], "_pos"))
    if rows.isEmpty():
        return rows.drop("_us", "_pos").withColumns({"anchor": F.col(id_col), "anchor_ts": F.col(ts)})
    own = rows.select(F.col("_us").alias("t"), F.lit(0).alias("kind"), F.col("_pos").alias("p"))
    ends = rows.select((F.col("_us") + seconds * 1_000_000).alias("t"), F.lit(1).alias("kind"), F.col("_pos").alias("p"))
    both = numbered(own.unionByName(ends), ["t", "kind", "p"], "place")  # an end stands behind its own number of ends and all times up to it
    steps = written(both.filter("kind = 1").select(F.col("p").alias("pos"), (F.col("place") - F.col("p")).alias("to")))
    total = rows.count()
    anchors = reached(steps.filter(F.col("to") < total), 0)
    marked = rows.join(anchors.select(F.col("pos").alias("_pos"), F.lit(True).alias("_opens")), "_pos", "left")
    opened = F.when(F.col("_opens"), F.struct(F.col(id_col).alias("anchor"), F.col(ts).alias("anchor_ts")))
    return carried(marked, ["_pos"], opened, "_a").select(*df.columns, "_a.anchor", "_a.anchor_ts")
