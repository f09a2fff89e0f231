"""Pattern catalogues in YAML, searches in them, and the compiler of their graph patterns to plans of joins.

A specification names nodes with labels and properties, relationships between them, paths of a bounded length, constraints of
time and of value, and an aggregation. Nodes become scans, relationships joins on their ends, paths chains of joins; constraints
become filters, or bounds on a group's aggregates. What isn't known is an error before anything runs.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewright.functions.scalars import iso_duration_seconds, micros
from tracewright.operators.interval import forward_join, renamed
from tracewright.plans.patterns import predicate

ACTION_ORDER = ("HIGH", "MEDIUM", "LOW")


@dataclass(frozen=True)
class Specification:
    """One document of a catalogue: metadata and detection, as mappings."""

    id: str
    name: str
    category: str
    risk: str
    tags: tuple[str, ...] = ()
    regulations: tuple[str, ...] = ()
    detection: dict[str, Any] = field(default_factory=dict)


def read_catalogue(texts: list[str]) -> list[Specification]:
    """Documents of YAML texts: each a pattern, or a list of them under patterns. An id that comes twice is an error."""
    import yaml

    found: dict[str, Specification] = {}
    for text in texts:
        for doc in yaml.safe_load_all(text):
            for p in (doc or {}).get("patterns", [doc] if doc else []):
                m = p["metadata"]
                if m["id"] in found:
                    raise ValueError(f"two patterns named {m['id']}")
                found[m["id"]] = Specification(m["id"], m["name"], m.get("category", ""), m.get("risk_level", ""), tuple(m.get("tags", ())), tuple(m.get("regulatory_implications", ())), p.get("detection", {}))
    return list(found.values())


def catalogue_table(spark: SparkSession, specifications: list[Specification]) -> DataFrame:
    """(id, name, category, risk, tags, regulations): what searches look at."""
    return spark.createDataFrame([(s.id, s.name, s.category, s.risk, list(s.tags), list(s.regulations)) for s in specifications], "id string, name string, category string, risk string, tags array<string>, regulations array<string>")


def search(catalogue: DataFrame, id_: str | None = None, category: str | None = None, risk: str | None = None, tags: tuple[str, ...] = (), regulations: tuple[str, ...] = ()) -> DataFrame:
    """Patterns that meet everything asked for; of tags and regulations any one is enough."""
    for column, wanted in (("id", id_), ("category", category), ("risk", risk)):
        if wanted is not None:
            catalogue = catalogue.filter(F.col(column) == wanted)
    for column, some in (("tags", tags), ("regulations", regulations)):
        if some:
            catalogue = catalogue.filter(F.arrays_overlap(column, F.array(*map(F.lit, some))))
    return catalogue


TEMPORAL = ("TIME_WINDOW", "VELOCITY", "FREQUENCY", "SEQUENCE", "TIME_OF_DAY", "DAY_OF_WEEK")
VALUE = ("THRESHOLD", "RANGE", "STRUCTURING", "RATIO", "ROUNDED")


def value_filter(kind: str, c: Column, p: dict[str, Any]) -> Column:
    """A constraint on one column: bounds are included; structuring takes the share margin below the threshold."""
    if kind == "THRESHOLD":
        found = F.lit(True)
        if "min" in p:
            found = found & (c >= p["min"])
        return found & (c <= p["max"]) if "max" in p else found
    if kind == "RANGE":
        return c.between(p["min"], p["max"])
    if kind == "STRUCTURING":
        return (c >= p.get("threshold", 10_000) * (1 - p.get("margin", 0.2))) & (c < p.get("threshold", 10_000))
    if kind == "ROUNDED":
        return F.pmod(c, F.lit(p.get("unit", 1000))) == 0
    raise ValueError(f"unknown value constraint {kind}")


def time_filter(kind: str, c: Column, p: dict[str, Any], anchor: Column) -> Column:
    """Hours and days of the week (Monday is 0) are included; a window reaches back from the anchor."""
    if kind == "TIME_WINDOW":
        return micros(c) >= micros(anchor) - iso_duration_seconds(p["duration"]) * 1_000_000
    if kind == "TIME_OF_DAY":
        return F.hour(c).between(p["from"], p["to"])
    if kind == "DAY_OF_WEEK":
        return F.weekday(c).isin(*p["days"])
    raise ValueError(f"unknown temporal constraint {kind}")


def compile_specification(s: Specification, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The matches of a pattern, or its groups if it aggregates, with columns pattern and risk before the others.

    nodes: id, label and properties. edges: edge_id, src, dst, type, value, ts. A relationship r between nodes a and b gives
    columns a_id, b_id, r_value, r_ts, r_edge; a path gives its ends, its number of edges, its first and last value and times. Edges
    of a match differ from each other. Without relationships and paths, the pattern is about single edges named e.
    """
    d = s.detection
    graph = d.get("graph_pattern", {})
    known = {n["id"]: n for n in graph.get("nodes", [])}
    anchor = edges.agg(F.max("ts").alias("_anchor"))
    matches: DataFrame | None = None
    bound: set[str] = set()

    def scan(node: str) -> DataFrame:
        spec = known[node]
        rows = nodes
        if spec.get("labels"):
            rows = rows.filter(F.col("label").isin(*spec["labels"]))
        for c, wanted in spec.get("properties", {}).items():
            if c not in nodes.columns:
                raise ValueError(f"unknown property {c}")
            rows = rows.filter(predicate(F.col(c), wanted))
        return rows.select(F.col("id").alias(f"{node}_id")).distinct()

    def attach(rows: DataFrame, ends: tuple[str, str]) -> None:
        nonlocal matches
        unknown = set(ends) - set(known)
        if unknown:
            raise ValueError(f"unknown nodes {sorted(unknown)}")
        for node in ends:
            if node not in bound and (known[node].get("labels") or known[node].get("properties")):
                rows = rows.join(scan(node), f"{node}_id", "left_semi")
        if matches is None:
            matches = rows
        else:
            shared = [f"{n}_id" for n in ends if n in bound]
            used = [c for c in matches.columns if c.endswith("_edge")]
            matches = matches.join(rows, shared) if shared else matches.crossJoin(rows)
            new = [c for c in rows.columns if c.endswith("_edge")]
            for x in used:
                for y in new:
                    matches = matches.filter(F.col(x) != F.col(y))
        bound.update(ends)

    def typed(types: list[str] | None) -> DataFrame:
        return edges.filter(F.col("type").isin(*types)) if types else edges

    for k, r in enumerate(graph.get("relationships", [])):
        a, b = (r["source"], r["target"]) if r.get("direction", "OUT") != "IN" else (r["target"], r["source"])
        name = r.get("id", f"r{k}")
        rows = typed([r["type"]] if r.get("type") else None)
        for c, wanted in r.get("properties", {}).items():
            if c not in edges.columns:
                raise ValueError(f"unknown property {c}")
            rows = rows.filter(predicate(F.col(c), wanted))
        cols = [F.col("src").alias(f"{a}_id"), F.col("dst").alias(f"{b}_id"), F.col("value").alias(f"{name}_value"), F.col("ts").alias(f"{name}_ts"), F.col("edge_id").alias(f"{name}_edge")]
        found = rows.select(*cols)
        if r.get("direction") == "BOTH":
            found = found.unionByName(rows.select(F.col("dst").alias(f"{a}_id"), F.col("src").alias(f"{b}_id"), *cols[2:]))
        attach(found, (a, b))
    for k, p in enumerate(graph.get("path_patterns", [])):
        attach(trails(typed(p.get("relationship_types")), p["min_length"], p["max_length"], iso_duration_seconds(p["within"]) if "within" in p else None, (p["start_node"], p["end_node"]), p.get("id", f"p{k}")), (p["start_node"], p["end_node"]))
    if matches is None:
        matches = edges.select(F.col("edge_id").alias("e_edge"), F.col("src").alias("e_src"), F.col("dst").alias("e_dst"), F.col("value").alias("e_value"), F.col("ts").alias("e_ts"))

    late: list[tuple[str, dict[str, Any]]] = []
    for c in d.get("temporal_constraints", []):
        kind, on_, p = c["type"], c.get("property", "e_ts"), c.get("parameters", {})
        if kind not in TEMPORAL:
            raise ValueError(f"unknown temporal constraint {kind}")
        if kind in ("VELOCITY", "FREQUENCY"):
            late.append((kind, {"on": on_, **p}))
        elif kind == "SEQUENCE":
            for x, y in zip(p["order"], p["order"][1:]):
                matches = matches.filter(F.col(x) < F.col(y))
        else:
            matches = matches.crossJoin(F.broadcast(anchor)).filter(time_filter(kind, F.col(on_), p, F.col("_anchor"))).drop("_anchor")  # one row
    for c in d.get("value_constraints", []):
        kind, p = c["type"], c.get("parameters", {})
        if kind not in VALUE:
            raise ValueError(f"unknown value constraint {kind}")
        if kind == "RATIO":
            matches = matches.filter(F.col(p["end"]) >= p["ratio"] * F.col(p["start"]))
        else:
            matches = matches.filter(value_filter(kind, F.col(c.get("property", "e_value")), p))

    for rule in d.get("aggregation_rules", []):
        kinds = {"count": lambda c: F.count("*"), "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev_samp, "distinct": F.countDistinct}
        aggregates, bounds = [], []
        for name, h in rule.get("having", {}).items():
            if h["function"] not in kinds:
                raise ValueError(f"unknown aggregate {h['function']}")
            aggregates.append(kinds[h["function"]](h.get("column", "*")).alias(name))
            bounds.append((name, {k: v for k, v in h.items() if k.startswith("$")}))
        spans = [((F.max(micros(F.col(p["on"]))) - F.min(micros(F.col(p["on"])))) / 1e6).alias(f"_span{k}") for k, (_, p) in enumerate(late)]
        matches = matches.groupBy(*rule["group_by"]).agg(*aggregates, F.count("*").alias("_n"), *spans)
        for name, wanted in bounds:
            matches = matches.filter(predicate(F.col(name), wanted))
        for k, (kind, p) in enumerate(late):
            if kind == "VELOCITY":
                matches = matches.filter(F.col(f"_span{k}") <= p["days"] * 86_400)
            else:
                matches = matches.filter((F.col("_n") >= p["count"]) & (F.col(f"_span{k}") <= iso_duration_seconds(p["period"])))
        matches = matches.drop("_n", *[f"_span{k}" for k in range(len(late))])
    return matches.select(F.lit(s.id).alias("pattern"), F.lit(s.risk).alias("risk"), *matches.columns)


def trails(edges: DataFrame, least: int, most: int, seconds: int | None, ends: tuple[str, str], name: str) -> DataFrame:
    """Chains of least to most edges, each later than the one before and none twice; seconds: from the first edge to the last."""
    from tracewright.lineage import written

    step = edges.select("edge_id", "src", "dst", "value", "ts")
    p = step.select(F.col("src").alias("_a"), F.col("dst").alias("_b"), F.col("value").alias("_v0"), F.col("value").alias("_v1"), F.col("ts").alias("_t0"), F.col("ts").alias("_t1"), F.lit(1).alias("_n"))
    found = p if least <= 1 else None
    for n in range(2, most + 1):
        grown = forward_join(p, renamed(step, "_s"), [("_b", "src_s")], "_t1", "ts_s", seconds) if seconds else p.join(renamed(step, "_s"), F.col("_b") == F.col("src_s"))
        grown = grown.filter(F.col("ts_s") > F.col("_t1"))  # later each time, so no edge comes twice
        if seconds:
            grown = grown.filter(micros(F.col("ts_s")) - micros(F.col("_t0")) <= seconds * 1_000_000)
        p = written(grown.select("_a", F.col("dst_s").alias("_b"), "_v0", F.col("value_s").alias("_v1"), "_t0", F.col("ts_s").alias("_t1"), F.lit(n).alias("_n")))
        if n >= least:
            found = p if found is None else found.unionByName(p)
    return found.select(F.col("_a").alias(f"{ends[0]}_id"), F.col("_b").alias(f"{ends[1]}_id"), F.col("_n").alias(f"{name}_length"), F.col("_v0").alias(f"{name}_first"), F.col("_v1").alias(f"{name}_last"), F.col("_t0").alias(f"{name}_from"), F.col("_t1").alias(f"{name}_to"))
