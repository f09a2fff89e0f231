"""Delimited files: scans, samples with a count, the formats that loaders know, coercion of columns, rows that fail."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tracewright.functions.scalars import is_btc_address, is_evm_address
from tracewright.operators.quantiles import quantiles

#: Columns that a file of each format must have (fixed values).
FORMATS = {
    "transfers": ("hash", "from", "to", "value", "timestamp"),
    "token_transfers": ("hash", "from", "to", "token", "value", "timestamp"),
    "trades": ("hash", "trader", "dex", "bought", "sold", "amount", "timestamp"),
    "addresses": ("address",),
    "custom": (),
}


def scan(spark: SparkSession, path: str, schema: StructType | str | None = None, delimiter: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A file or folder with a header line. Without a schema all columns are text: nothing is read twice to guess types.

    Rows of too few fields get nulls; a missing path is an error when the plan is made.
    """
    reader = spark.read.option("header", True).option("sep", delimiter).option("encoding", encoding).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).csv(path)


def sample_and_count(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in an order, each with the number of all rows (total_rows); of an empty table none."""
    total = df.agg(F.count("*").alias("total_rows"))
    return df.orderBy(*order).limit(n).crossJoin(F.broadcast(total))  # one row


def missing_columns(df: DataFrame, form: str) -> list[str]:
    """Those of a format that df lacks; an unknown format is an error."""
    if form not in FORMATS:
        raise ValueError(f"unknown format {form!r}")
    return [c for c in FORMATS[form] if c not in df.columns]


def formats_met(df: DataFrame) -> list[str]:
    return [form for form in FORMATS if not missing_columns(df, form)]


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns that aren't there are passed over; a new name that another column has is an error."""
    new = {old: to for old, to in names.items() if old in df.columns}
    kept = [new.get(c, c) for c in df.columns]
    if len(set(kept)) < len(kept):
        raise ValueError(f"names meet: {kept}")
    return df.withColumnsRenamed(new)


def coerce(df: DataFrame, times: list[str], numbers: list[str], form: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Texts to timestamps and doubles; what can't be read becomes null."""
    done = {c: F.try_to_timestamp(F.col(c), F.lit(form)) for c in times} | {c: F.col(c).try_cast("double") for c in numbers}
    return df.withColumns(done)


def time_columns(df: DataFrame) -> list[str]:
    """Columns whose name has time or date in it."""
    return [c for c in df.columns if "time" in c.lower() or "date" in c.lower()]


def fill_medians(df: DataFrame, columns: list[str], key: str | None = None) -> DataFrame:
    """Nulls become the exact median of their column (of their key's rows, if given); a column without values stays null."""
    for c in columns:
        one = df.withColumn("_key", F.col(key)) if key else df.withColumn("_key", F.lit(0))
        middle = quantiles(one, "_key", c, {"_median": 0.5}).withColumnRenamed("_key", "_of")
        df = one.join(middle, F.col("_key").eqNullSafe(F.col("_of")), "left").withColumn(c, F.coalesce(c, "_median")).drop("_key", "_of", "_median")
    return df


@dataclass(frozen=True)
class Rules:
    """What a row must meet: columns that aren't null, addresses of a kind, numbers that are there and at least 0, times."""

    required: tuple[str, ...] = ()
    evm: tuple[str, ...] = ()
    btc: tuple[str, ...] = ()
    amounts: tuple[str, ...] = ()
    times: tuple[str, ...] = ()


def faults(df: DataFrame, rules: Rules, form: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """df with faults: the rules that a row breaks, each as kind:column, in the order of rules; empty for a good row.

    Addresses, amounts and times are texts. A null breaks its rule once (as required, if it is, else as its kind).
    """

    def one(kind: str, column: str, good: Column) -> Column:
        return F.when(~F.coalesce(good, F.lit(False)), F.lit(f"{kind}:{column}"))

    checks = [one("required", c, F.col(c).isNotNull()) for c in rules.required]
    for kind, columns, test in (("evm", rules.evm, is_evm_address), ("btc", rules.btc, is_btc_address)):
        checks += [one(kind, c, F.col(c).isNull() & F.lit(c in rules.required) | test(F.col(c))) for c in columns]
    checks += [one("amount", c, F.col(c).isNull() & F.lit(c in rules.required) | (F.col(c).try_cast("double") >= 0)) for c in rules.amounts]
    checks += [one("time", c, F.col(c).isNull() & F.lit(c in rules.required) | F.try_to_timestamp(F.col(c), F.lit(form)).isNotNull()) for c in rules.times]
    return df.withColumn("faults", F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"))


def valid_rows(df: DataFrame, rules: Rules) -> DataFrame:
    """The rows without faults. Where there are rows and none is good, that is an error (two short jobs look for one of each)."""
    good = faults(df, rules).filter(F.size("faults") == 0).drop("faults")
    if good.isEmpty() and not df.isEmpty():
        raise ValueError("no valid rows")
    return good
