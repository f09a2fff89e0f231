"""What the operators of this subpackage share: reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that the driver and all executors see.

    Where it is unset, a local master (one process, as in tests) gets a temporary folder; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="tracewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str, rows: int | None = None, per_file: int = 250_000) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that later stages survive the loss of any executor.

    rows: about how many there will be, where that is known; small tables then get few files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if rows is not None and rows // per_file < 64:
        df = df.coalesce(rows // per_file + 1)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold_of(column: str, parts: int) -> Column:
    """The held-out rule of all queries here: crc32 of the id as text, modulo parts."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts))


def crc32_sql(column: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an integer column as text: by the eight shifts of each byte (fixed value: the reflected polynomial)."""
    bits = "c"
    for _ in range(8):
        bits = f"list_transform([{bits}], lambda c: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)[1]"
    characters = f"list_transform(string_split({column}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {characters}), lambda s, b: list_transform([xor(s, b)], lambda c: {bits})[1]), 4294967295::BIGINT)"
