"""Declarative fraud patterns: a specification becomes a DataFrame plan.

A pattern names a relation of transfers, predicates on its columns, a grouping, and bounds on the group's aggregates.
Unknown operators, aggregates and columns are errors before anything runs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tracewright.functions.scalars import iso_duration_seconds, micros

OPERATORS = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(*v),
    "$range": lambda c, v: c.between(*v),
}
AGGREGATES = {"count": lambda c: F.count("*"), "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "distinct": F.countDistinct}


@dataclass(frozen=True)
class Pattern:
    """where: column to value, or to operators. having: name to (aggregate, column, operators). window: time before the last row."""

    name: str
    risk: str
    group_by: tuple[str, ...]
    where: dict = field(default_factory=dict)
    having: dict = field(default_factory=dict)
    window: str | None = None
    within: str | None = None
    actions: tuple[str, ...] = ()


def predicate(c: Column, wanted: object) -> Column:
    """A bare value is equality; a mapping holds operators that must all be met."""
    if not isinstance(wanted, dict):
        return c == wanted
    found = F.lit(True)
    for op, v in wanted.items():
        if op not in OPERATORS:
            raise ValueError(f"unknown operator {op}")
        found = found & OPERATORS[op](c, v)
    return found


def predicates(wanted: dict) -> Column:
    """All of several columns' predicates."""
    found = F.lit(True)
    for c, w in wanted.items():
        found = found & predicate(F.col(c), w)
    return found


def compile_pattern(p: Pattern, t: DataFrame) -> DataFrame:
    """(pattern, risk, key, the named aggregates, actions): one row for each group that meets the pattern."""
    missing = ({*p.where, *p.group_by} | {c for _, c, _ in p.having.values() if c != "*"}) - {*t.columns}
    if missing:
        raise ValueError(f"unknown columns {sorted(missing)}")
    unknown = {a for a, _, _ in p.having.values()} - {*AGGREGATES}
    if unknown:
        raise ValueError(f"unknown aggregates {sorted(unknown)}")
    rows = t
    for c, wanted in p.where.items():
        rows = rows.filter(predicate(F.col(c), wanted))
    if p.window:
        last = t.agg(F.max("ts").alias("_anchor"))
        rows = rows.crossJoin(F.broadcast(last)).filter(micros(F.col("ts")) >= micros(F.col("_anchor")) - iso_duration_seconds(p.window) * 1_000_000)  # one row
    aggregates = [AGGREGATES[a](c).alias(name) for name, (a, c, _) in p.having.items()]
    span = (F.max(micros(F.col("ts"))) - F.min(micros(F.col("ts")))).alias("_span")
    groups = rows.groupBy(*p.group_by).agg(*aggregates, span)
    for name, (_, _, wanted) in p.having.items():
        groups = groups.filter(predicate(F.col(name), wanted))
    if p.within:
        groups = groups.filter(F.col("_span") <= iso_duration_seconds(p.within) * 1_000_000)
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in p.group_by])
    kept = [F.round(F.col(n), 4).alias(n) if a in ("sum", "avg") else F.col(n) for n, (a, _, _) in p.having.items()]
    return groups.select(F.lit(p.name).alias("pattern"), F.lit(p.risk).alias("risk"), key.alias("key"), *kept, F.lit(",".join(p.actions)).alias("actions"))
