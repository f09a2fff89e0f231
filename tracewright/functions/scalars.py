"""Scalar helpers: ladders, bands, checks of addresses and amounts, features of a transfer."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ladder(value: Column, steps: list[tuple[float, object]], other: object, strict: bool = True) -> Column:
    """The result of the first step whose bound value exceeds (or reaches, if not strict); bounds fall."""
    found = None
    for bound, result in steps:
        hit = value > F.lit(bound) if strict else value >= F.lit(bound)
        found = F.when(hit, F.lit(result)) if found is None else found.when(hit, F.lit(result))
    return found.otherwise(F.lit(other))


def is_evm_address(c: Column) -> Column:
    return F.coalesce(c.rlike("^0x[a-fA-F0-9]{40}$"), F.lit(False))


def is_btc_address(c: Column) -> Column:
    return F.coalesce(F.length(c).between(26, 35), F.lit(False))


def is_round_amount(v: Column, least: float = 10_000) -> Column:
    """Multiples of 1 000 (so also of 10 000 and 100 000) of at least so much."""
    return (F.pmod(v, F.lit(1000)) == 0) & (v >= least)


def just_below(v: Column) -> Column:
    """Inside (9 000, 10 000) or (4 500, 5 000)."""
    return ((v > 9000) & (v < 10000)) | ((v > 4500) & (v < 5000))


def structuring_band(v: Column, threshold: float = 10_000, margin: float = 0.2) -> Column:
    """[threshold * (1 - margin), threshold)."""
    return (v >= threshold * (1 - margin)) & (v < threshold)


def amount_bin(v: Column) -> Column:
    """(0, 1k] 1, (1k, 5k] 2, (5k, 10k] 3, (10k, 50k] 4, above 5; 0 for nothing or less."""
    return F.when(v <= 0, 0).when(v <= 1000, 1).when(v <= 5000, 2).when(v <= 10000, 3).when(v <= 50000, 4).otherwise(5)


def seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / 1e6


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def severity(value: Column, threshold: float) -> Column:
    """CRITICAL above 3, HIGH above 2, MEDIUM above 1.5 times the threshold, else LOW."""
    return ladder(value, [(3 * threshold, "CRITICAL"), (2 * threshold, "HIGH"), (1.5 * threshold, "MEDIUM")], "LOW")


def iso_duration_seconds(text: str) -> int:
    """PnDTnHnMnS in seconds; anything else is an error."""
    import re

    m = re.fullmatch(r"P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?", text)
    if not m or not any(m.groups()):
        raise ValueError(f"no duration: {text!r}")
    d, h, mi, s = (int(g or 0) for g in m.groups())
    return ((d * 24 + h) * 60 + mi) * 60 + s


def rule_severity(rules: dict[str, dict[str, float]], other: str = "LOW") -> Column:
    """The first severity of which all named columns reach their bound."""
    found = F.lit(other)
    for name, bounds in reversed(rules.items()):
        hit = F.lit(True)
        for column, bound in bounds.items():
            hit = hit & (F.col(column) >= bound)
        found = F.when(hit, F.lit(name)).otherwise(found)
    return found


def text_similarity(a: str, b: str) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty texts, null where one is null."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def vector_facts(v):
    """(vec_id, total, last, high, positive, unit) of short vectors e: sum, last and largest component, whether all are over 0, the first over the length."""
    e = F.col("e")
    length = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x))
    return v.select("vec_id", F.round(F.aggregate(e, F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.round(F.element_at(e, -1), 6).alias("last"), F.round(F.array_max(e), 6).alias("high"), F.forall(e, lambda x: x > 0).alias("positive"), F.round(F.try_divide(F.get(e, F.lit(0)), length), 5).alias("unit"))


def sorted_entries(df, key: str, column: str, wanted: str):
    """(key, entries, <wanted>s): a map's entries as name=number, the largest first and then by name, and one entry with 0 where it is missing."""
    by = lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).otherwise(1)
    text = F.array_join(F.transform(F.array_sort(F.map_entries(column), by), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return df.select(key, text.alias("entries"), F.coalesce(F.try_element_at(F.col(column), F.lit(wanted)), F.lit(0)).alias(f"{wanted}s"))
