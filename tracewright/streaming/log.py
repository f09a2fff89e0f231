"""An event log on a shared file system: appends with dense offsets, replay of ranges, retention, handlers, dead letters and what is pending.

    log/rows/append=7/part=3/...    rows in order, as one append wrote them; `at` numbers them within the part
    log/commits/append=7            per part: first offset, rows, smallest `at`; an append counts once this is there

A row is written once; its offset comes from the commits. Micro-batches write to folders named by their number, so that one that died
and runs again replaces what it has left behind.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

COMMITS = "append_id string, part int, first long, n long, low long, append int"


def _folder(spark: SparkSession, path: str):  # noqa: ANN202  a Java file system and path
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _folder(spark, path)
    return fs.exists(at)


def commits(spark: SparkSession, log: str) -> DataFrame:
    """append_id, part, first, n, low and append: one row for each part of each append; none for a log that isn't there."""
    if not _exists(spark, f"{log}/commits"):
        return spark.createDataFrame([], COMMITS)
    return spark.read.schema(COMMITS).parquet(f"{log}/commits")


def append(rows: DataFrame, log: str, order: list[str], append_id: str) -> None:
    """Rows in the given order behind all that the log has; offsets are dense. The same append_id a second time changes nothing.

    Rows are dealt by range, so no task holds them all; rows equal in `order` take any order among themselves. One writer at a time.
    An append that dies before its commit is overwritten by the next. rows may not have columns named append, part or at.
    """
    spark, known = rows.sparkSession, commits(rows.sparkSession, log)
    found = known.agg(F.max("append").alias("last"), F.max(F.col("first") + F.col("n")).alias("offset"), F.count(F.when(F.col("append_id") == append_id, 1)).alias("had")).first()
    if found["had"]:
        return
    number, offset = (found["last"] or 0) + 1, found["offset"] or 0
    here = f"{log}/rows/append={number}"
    dealt = rows.withColumn("_salt", F.rand(5)).repartitionByRange(*order, "_salt").sortWithinPartitions(*order).drop("_salt")
    dealt.withColumns({"at": F.monotonically_increasing_id(), "part": F.spark_partition_id()}).write.mode("overwrite").partitionBy("part").parquet(here)
    if rows.isEmpty():
        return
    sizes = spark.read.parquet(here).groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("low"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # as many rows as parts
    done = sizes.select(F.lit(append_id).alias("append_id"), F.col("part").cast("int"), (before + offset).cast("long").alias("first"), "n", "low")
    done.coalesce(1).write.mode("overwrite").parquet(f"{log}/commits/append={number}")


def _scan(spark: SparkSession, log: str, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """The rows from one part of one append to another; folders before and behind them are pruned."""
    (a, p), (b, q) = first, last
    return spark.read.parquet(f"{log}/rows").filter((F.col("append") >= a) & (F.col("append") <= b) & ((F.col("append") > a) | (F.col("part") >= p)) & ((F.col("append") < b) | (F.col("part") <= q)))


def replay(spark: SparkSession, log: str, since: int = 0, until: int | None = None) -> DataFrame:
    """Rows with offsets from `since` up to, not including, `until`, and their column offset. Only the parts that hold some are read."""
    parts = commits(spark, log).filter((F.col("first") + F.col("n") > since) & (F.lit(True) if until is None else F.col("first") < until))
    ends = parts.agg(F.min(F.struct("append", "part")).alias("a"), F.max(F.struct("append", "part")).alias("b")).first()
    if ends["a"] is None:
        if not _exists(spark, f"{log}/rows"):
            raise ValueError(f"{log}: there is no log")
        return spark.read.parquet(f"{log}/rows").filter("false").drop("at", "part", "append").withColumn("offset", F.lit(0).cast("long"))
    (a, p), (b, q) = ends["a"], ends["b"]
    placed = _scan(spark, log, (a, p), (b, q)).join(parts.select("append", "part", "first", "low"), ["append", "part"]).withColumn("offset", F.col("first") + F.col("at") - F.col("low"))
    kept = placed.filter((F.col("offset") >= since) & (F.lit(True) if until is None else F.col("offset") < until))
    return kept.drop("append", "part", "at", "first", "low")


def trim(spark: SparkSession, log: str, keep: int) -> None:
    """Drops the appends of which no row is among the last `keep`; offsets of the others stay."""
    whole = commits(spark, log).groupBy("append").agg(F.max(F.col("first") + F.col("n")).alias("end"))
    last = whole.agg(F.max("end")).first()[0] or 0
    for r in whole.filter(F.col("end") <= last - keep).collect():  # one row for each append
        for kind in ("commits", "rows"):
            fs, at = _folder(spark, f"{log}/{kind}/append={r['append']}")
            fs.delete(at, True)


def message(columns: list[str]) -> Column:
    """A row as text; null fields stay in it, and times keep their microseconds."""
    at = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false", "timestampFormat": f"{at}XXX", "timestampNTZFormat": at})


def decoded(rows: DataFrame, column: str, schema: StructType) -> DataFrame:
    """The columns of schema from a message."""
    return rows.select(F.from_json(column, schema).alias("m")).select("m.*")


def deliver(stream: DataFrame, place: str, error: Column, id_col: str, name: str) -> None:
    """Each row of a stream to place/rows, or to place/dead where `error` says what is wrong (null: nothing); goes on where it ended.

    Both sinks have a folder for each micro-batch. One that died between the two, or in one of them, runs again under its number and
    overwrites both, so no row is lost and none comes twice. Dead letters: original_id, stream, error and the row as message.
    """
    columns = stream.columns

    def each(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("_error", error)
        marked.filter("_error IS NULL").drop("_error").write.mode("overwrite").parquet(f"{place}/rows/batch={number}")
        letters = marked.filter("_error IS NOT NULL").select(F.col(id_col).alias("original_id"), F.lit(name).alias("stream"), F.col("_error").alias("error"), message(columns).alias("message"))
        letters.write.mode("overwrite").parquet(f"{place}/dead/batch={number}")

    stream.writeStream.option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def delivered(spark: SparkSession, place: str, kind: str = "rows") -> DataFrame:
    """kind: rows or dead."""
    return spark.read.parquet(f"{place}/{kind}").drop("batch")


def pending(log_rows: DataFrame, place: str, id_col: str, ts: str | None = None, now: Column | None = None, idle: int = 30) -> DataFrame:
    """Rows of the log that are in neither sink; with ts, only those of at least `idle` seconds. Their number is the consumer's lag."""
    spark = log_rows.sparkSession
    open_rows = log_rows
    for kind, key in (("rows", id_col), ("dead", "original_id")):
        if _exists(spark, f"{place}/{kind}"):
            seen = delivered(spark, place, kind).select(F.col(key).alias("_seen"))
            open_rows = open_rows.join(seen, F.col(id_col) == F.col("_seen"), "left_anti")
    if ts is None:
        return open_rows
    return open_rows.filter(F.unix_micros(now) - F.unix_micros(F.col(ts).cast("timestamp")) >= idle * 1_000_000)


@dataclass(frozen=True)
class Handler:
    """write(rows, number of the micro-batch) must replace what it wrote for that number before."""

    name: str
    priority: int
    matches: Column
    write: Callable[[DataFrame, int], None]


def dispatch(stream: DataFrame, checkpoint: str, handlers: list[Handler]) -> None:
    """Each handler gets the rows that it matches, once; those of a higher priority come first, then by name."""
    order = sorted(handlers, key=lambda h: (-h.priority, h.name))

    def each(batch: DataFrame, number: int) -> None:
        for h in order:
            h.write(batch.filter(h.matches), number)

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
