"""Structured Streaming over the same rows: filters, alerts, windows with watermarks, sessions, rows that come twice, budgets.

Each function takes and gives a DataFrame that may be a stream. run_available() runs a stream over what is there and ends.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tracewright.lineage import shared_folder


def events_from(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    """A stream of the Parquet files that path names (a folder, or a pattern with *), so many in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def high_risk(stream: DataFrame, kinds: list[str], least: float) -> DataFrame:
    """Rows of some kinds over a value, typed: event_id, user_id, kind, value, ts."""
    kept = stream.filter(F.col("event_type").isin(*kinds) & (F.col("value") > least))
    return kept.select("event_id", "user_id", F.col("event_type").alias("kind"), F.col("value").cast("double").alias("value"), F.col("ts").cast("timestamp").alias("ts"))


def alerts(stream: DataFrame, least: float, high: float = 10.0) -> DataFrame:
    """Rows of at least so much; HIGH from high times that on."""
    return stream.filter(F.col("value") >= least).select("event_id", "user_id", "value", F.when(F.col("value") >= high * least, "HIGH").otherwise("MEDIUM").alias("level"))


def tumbling(stream: DataFrame, ts: str, keys: list[str], span: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, keys, n, total): rows by window of time; what comes later than the watermark is dropped once its window has closed."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    g = timed.groupBy(F.window("_ts", span).alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """(key, start, n): runs of a key's rows with less than the gap between neighbours."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(key, F.session_window("_ts", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def once(stream: DataFrame, ts: str, key: str, late: str = "10 minutes") -> DataFrame:
    """Rows without those whose key came before, within the watermark; of a table, one row for each key."""
    if not stream.isStreaming:
        return stream.dropDuplicates([key])
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.dropDuplicatesWithinWatermark([key]).drop("_ts")


def run_available(stream: DataFrame, mode: str = "append", place: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """The result of a stream over all that is there, from a table in the shared folder, where its checkpoint is, too.

    update: rows that a micro-batch has changed go to a folder named by its number, and of each of the `keys` the newest row counts; what
    the watermark has passed leaves the state. place: a folder to go on from; what an earlier run there has read isn't read again.
    """
    spark = stream.sparkSession
    place = place or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True)
    if mode == "update":
        query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{place}/rows/batch={n}")).start()
    else:
        query = writer.format("parquet").option("path", f"{place}/rows").start()
    query.awaitTermination()
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(f"{place}/rows")
    rows = spark.read.parquet(f"{place}/rows")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("_r")).select("_r.*")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """While a stream with arbitrary state starts: Spark asks for RocksDB then."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, was)
