"""Joins on a key and a span of time, cut into bins so that they stay equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewright.functions.scalars import micros


def forward_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], left_ts: str, right_ts: str, seconds: int, least: int = 0) -> DataFrame:
    """Rows of left and right with equal keys where right's time is least to seconds after left's (both included).

    Every left row goes to the bins that its span can reach (two or three of them), every right row to its own, so a row of the
    result is made once. Column names of the two sides must differ. Null keys and times match nothing.
    """
    width = seconds * 1_000_000 or 1
    lo, hi = micros(F.col(left_ts)) + least * 1_000_000, micros(F.col(left_ts)) + seconds * 1_000_000
    a = left.withColumn("_bin", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))
    b = right.withColumn("_bin2", F.floor(micros(F.col(right_ts)) / width))
    on: Column = F.col("_bin") == F.col("_bin2")
    for x, y in keys:
        on = on & (F.col(x) == F.col(y))
    gap = micros(F.col(right_ts)) - micros(F.col(left_ts))
    return a.join(b, on & (gap >= least * 1_000_000) & (gap <= seconds * 1_000_000)).drop("_bin", "_bin2")


def renamed(df: DataFrame, suffix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}{suffix}") for c in df.columns])
