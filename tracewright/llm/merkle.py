"""Merkle manifest of a dataset: a tree of 16 branches for each source, a tree over the sources, and a proof for each row.

Leaves are dealt in aligned blocks. A stack (treehash) makes each block's root; the roots climb in blocks of their own until each
source has one node, and so do the sources. On the way down, a traversal advances each block's authentication path leaf by leaf:
for each level it holds the run of siblings in use, and a treehash takes one leaf a step to have the next run ready in time, so
that a block needs memory in the logarithm of its leaves beside the digests themselves. The path above a block is shared by its leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewright.llm.base import crc32_sql, fold_of, materialize, table
from tracewright.llm.order import joined, numbered

#: Fixed value: branches of a node.
FAN = 16
#: Levels of a block, and so its leaves.
LEVELS = 3
BLOCK = FAN**LEVELS

#: A path has, for each level from the leaf up, the siblings before and after the own node, as joined hex text.
PATH = "array<struct<before: string, after: string>>"
Path = list[tuple[str, str]]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above n nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


class Treehash:
    """The nodes of one level over the leaves fed so far, one leaf at a time; below it at most FAN - 1 nodes a level wait."""

    def __init__(self, level: int) -> None:
        self.level, self.rows = level, [[] for _ in range(level + 1)]

    def feed(self, leaf: str) -> None:
        row = 0
        self.rows[0].append(leaf)
        while row < self.level and len(self.rows[row]) == FAN:
            self._raise(row)
            row += 1

    def close(self) -> list[str]:
        """After the last leaf: what waits goes up as shorter runs."""
        for row in range(self.level):
            if self.rows[row]:
                self._raise(row)
        return self.rows[self.level]

    def _raise(self, row: int) -> None:
        self.rows[row + 1].append(digest("".join(self.rows[row])))
        self.rows[row] = []


def root_of(leaves: list[str], levels: int) -> str:
    stack = Treehash(levels)
    for leaf in leaves:
        stack.feed(leaf)
    return stack.close()[0]


def traverse(leaves: list[str], levels: int) -> Iterator[Path]:
    """The path of each leaf of a block, in order."""
    n, spans = len(leaves), [FAN ** (k + 1) for k in range(levels)]
    runs, coming, parts = [], [], [("", "")] * levels
    for k, span in enumerate(spans):
        first = Treehash(k)
        for leaf in leaves[:span]:
            first.feed(leaf)
        runs.append(first.close())
        coming.append(Treehash(k))
    for i in range(n):
        for k, span in enumerate(spans):
            if i and i % span == 0:
                runs[k], coming[k] = coming[k].close(), Treehash(k)
            if i % (span // FAN) == 0:
                own = i * FAN // span % FAN
                parts[k] = ("".join(runs[k][:own]), "".join(runs[k][own + 1 :]))
            if i + span < n:
                coming[k].feed(leaves[i + span])
        yield list(parts)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (_key, _block), which lie together, as one table."""
    waiting, last = [], None
    for batch in batches:
        at, names = 0, list(zip(batch.column("_key").to_pylist(), batch.column("_block").to_pylist(), strict=True))
        for i, name in enumerate(names):
            if name != last:
                waiting.append(batch.slice(at, i - at))
                if last is not None:
                    yield pa.Table.from_batches(waiting)
                waiting, at, last = [], i, name
        waiting.append(batch.slice(at))
    if last is not None:
        yield pa.Table.from_batches(waiting)


def gathered(tables: Iterator[pa.Table], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """As batches of some size, for blocks may be of one row."""
    waiting, n = [], 0
    for t in tables:
        waiting.append(t)
        n += t.num_rows
        if n >= BLOCK:
            yield from pa.concat_tables(waiting).combine_chunks().to_batches()
            waiting, n = [], 0
    if waiting:
        yield from pa.concat_tables(waiting).combine_chunks().to_batches()


def by_block(nodes: DataFrame) -> DataFrame:
    """Whole blocks in one task each, in order; at most BLOCK nodes (and the path above them) have one name."""
    return nodes.repartition("_key", "_block").sortWithinPartitions("_key", "_block", "_pos")


def block_roots(nodes: DataFrame) -> DataFrame:
    """_key, _pos (of the block among the key's blocks), _n (blocks of the key) and _digest, from the same columns of nodes."""
    kind = nodes.schema["_key"].dataType.simpleString()

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(t: pa.Table) -> pa.Table:
            n = t["_n"][0].as_py()
            root = root_of(t["_digest"].to_pylist(), min(LEVELS, height(n)))
            return pa.table({"_key": t["_key"].slice(0, 1), "_pos": t["_block"].slice(0, 1), "_n": pa.array([-(-n // BLOCK)], pa.int64()), "_digest": pa.array([root], pa.string())})

        yield from gathered(map(one, blocks(batches)), None)

    placed = nodes.select("_key", "_pos", "_n", "_digest", F.expr(f"_pos div {BLOCK}").alias("_block"))
    return by_block(placed).mapInArrow(climb, f"_key {kind}, _pos long, _n long, _digest string")


def below(nodes: DataFrame, upper: DataFrame, kept: list[str], emit: Callable[[pa.Table, Iterator[Path], Path, str], pa.Table], out: str) -> DataFrame:
    """Each block of nodes meets the path above it (upper: _key, _pos, _sub, _path) and goes through emit(rows, paths, path above, subroot)."""
    heads = upper.select("_key", F.col("_pos").alias("_block"), "_path", "_sub", F.lit(-1).cast("long").alias("_pos"))
    placed = nodes.select("_key", "_pos", "_n", "_digest", *kept, F.expr(f"_pos div {BLOCK}").alias("_block"))

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(t: pa.Table) -> pa.Table:
            above, sub, t = t["_path"][0].as_py(), t["_sub"][0].as_py(), t.slice(1)
            paths = traverse(t["_digest"].to_pylist(), min(LEVELS, height(t["_n"][0].as_py())))
            return emit(t, paths, [(x["before"], x["after"]) for x in above], sub)

        yield from gathered(map(one, blocks(batches)), None)

    return by_block(placed.unionByName(heads, allowMissingColumns=True)).mapInArrow(descend, out)


def _paths(t: pa.Table, paths: Iterator[Path], above: Path, sub: str) -> pa.Table:
    whole = [[{"before": b, "after": a} for b, a in [*p, *above]] for p in paths]
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    return pa.table({"_key": t["_key"], "_pos": t["_pos"], "_sub": pa.array([sub] * len(t), pa.string()), "_path": pa.array(whole, kind)})


def climb_all(nodes: DataFrame, tag: str) -> list[DataFrame]:
    """Block roots of nodes, their block roots and so on, until each key has one node: log(nodes) / log(BLOCK) rounds."""
    levels = [materialize(block_roots(nodes), tag)]
    while not (more := levels[-1].filter("_n > 1")).isEmpty():
        levels.append(materialize(block_roots(more), tag))
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, [x.filter("_n = 1").select("_key", "_digest") for x in levels])


def descend_to(levels: list[DataFrame], above: DataFrame, tag: str) -> DataFrame:
    """_key, _pos, _sub and _path of the nodes of levels[0], from those of the keys' one nodes (above: _key, _sub, _path)."""
    found, kind = None, above.schema["_key"].dataType.simpleString()
    for level in reversed(levels):
        done = level.filter("_n = 1")
        paths = joined(done, above, ["_key"]).select("_key", "_pos", "_sub", "_path")
        if found is not None:
            paths = paths.unionByName(below(level.filter("_n > 1"), found, [], _paths, f"_key {kind}, _pos long, _sub string, _path {PATH}"))
        found = materialize(paths, tag)
    return found


def field(value: Column) -> Column:
    """- for null, else the bytes of the UTF-8 text, a colon and the text."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _proven(rows: DataFrame, id_col: str, source_col: str, leaf: Column, other: Column | None, emit_for: Callable[[str | None], tuple[Callable, str]], kept: list[str]) -> DataFrame:
    picked = rows.select(F.col(source_col).alias("_key"), F.col(id_col).alias("_id"), leaf.alias("_digest"), (F.lit(None).cast("string") if other is None else other).alias("_other"))
    nodes = numbered(picked, ["_key"], ["_id", "_digest"], "merkle-leaves")
    levels = climb_all(nodes, "merkle-nodes")
    subroots = tops(levels).withColumnsRenamed({"_key": "_source", "_digest": "_subroot"})
    ordered = numbered(subroots.withColumn("_key", F.lit(0)), ["_key"], ["_source"], "merkle-sources")
    sources = materialize(ordered.select("_key", "_pos", "_n", F.col("_subroot").alias("_digest"), "_source"), "merkle-sources")
    rounds = climb_all(sources, "merkle-roots")
    root = next((r["_digest"] for r in tops(rounds).collect()), None)  # one row, or none
    nothing = F.from_json(F.lit("[]"), PATH)
    upper = descend_to(rounds, tops(rounds).select("_key", F.col("_digest").alias("_sub"), nothing.alias("_path")), "merkle-paths")
    own = sources.schema["_source"].dataType.simpleString()

    def of_source(t: pa.Table, paths: Iterator[Path], above: Path, sub: str) -> pa.Table:
        found = _paths(t, paths, above, sub)
        return pa.table({"_key": t["_source"], "_sub": t["_digest"], "_path": found["_path"]})

    above = materialize(below(sources, upper, ["_source"], of_source, f"_key {own}, _sub string, _path {PATH}"), "merkle-paths")
    emit, out = emit_for(root)
    return below(nodes, descend_to(levels, above, "merkle-paths"), kept, emit, out)


def authentication_paths(rows: DataFrame, values: list[str], id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """id_col, leaf, subroot, root and path (before and after of each level, from the leaf to the root) of every row.

    See manifest for what values do, and for nulls, ties and empty tables.
    """

    def emit_for(root: str | None) -> tuple[Callable, str]:
        def emit(t: pa.Table, paths: Iterator[Path], above: Path, sub: str) -> pa.Table:
            found = _paths(t, paths, above, sub)
            return pa.table({id_col: t["_id"], "leaf": t["_digest"], "subroot": found["_sub"], "root": pa.array([root] * len(t), pa.string()), "path": found["_path"]})

        return emit, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, leaf string, subroot string, root string, path {PATH}"

    return _proven(rows, id_col, source_col, leaf_of([F.col(c) for c in values]), None, emit_for, ["_id"])


def manifest(rows: DataFrame, values: list[str], changed: dict[str, Column] | None = None, changed_where: Column | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """id_col, leaf, subroot, root, proof_sha256 (all siblings from the leaf up, each level left to right), folded_root and verified.

    A leaf hashes values in order. folded_root folds the leaf with its siblings up to the root; where changed_where holds, the leaf
    is that of the row with `changed` in place of its values, so verified tells whether the row still is what the manifest says.
    Leaves of a source go by id_col (nulls first), equal ids by leaf; equal rows take any order, each with a proof of its own.
    Null is a source as any other, and the first. An empty table gives an empty result. Other columns are not read.
    """
    leaf = leaf_of([F.col(c) for c in values])
    other = None
    if changed:
        other = F.when(F.lit(True) if changed_where is None else changed_where, leaf_of([changed.get(c, F.col(c)) for c in values]))

    def emit_for(root: str | None) -> tuple[Callable, str]:
        def emit(t: pa.Table, paths: Iterator[Path], above: Path, sub: str) -> pa.Table:
            tail = "".join(b + a for b, a in above).encode()
            proofs, folded = [], []
            for own, path in zip([o or d for o, d in zip(t["_other"].to_pylist(), t["_digest"].to_pylist(), strict=True)], paths, strict=True):
                proof = hashlib.sha256("".join([x for pair in path for x in pair]).encode())
                proof.update(tail)
                proofs.append(proof.hexdigest())
                for b, a in path:
                    own = digest(b + own + a)
                for b, a in above:
                    own = digest(b + own + a)
                folded.append(own)
            text = [pa.array(x, pa.string()) for x in ([sub] * len(t), [root] * len(t), proofs, folded)]
            return pa.table([t["_id"], t["_digest"], *text, pa.array([x == root for x in folded], pa.bool_())], names=[id_col, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

        return emit, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    return _proven(rows, id_col, source_col, leaf, other, emit_for, ["_id", "_other"])


#: What a leaf hashes, in order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth document, by the crc32 of its id, is held against the manifest in lower case."""
    return manifest(table(spark, sf_dir, "documents"), FIELDS, {"text": F.translate("text", UPPER, LOWER)}, fold_of("doc_id", 5) == 0)


def _sql() -> str:
    def part(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR END"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(part(c if c != 'text' else text) for c in FIELDS)})"

    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('s' || source, '-') AS tree, {leaf("text")} AS leaf,
    CASE WHEN {crc32_sql('doc_id')} % 5 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other,
    row_number() OVER (PARTITION BY source ORDER BY doc_id, {leaf("text")}) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents),
up(tree, source, level, pos, n, digest) AS (SELECT tree, source, 0, pos, n, leaf FROM d
  UNION ALL SELECT tree, any_value(source), level + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, level, pos // 16),
s AS (SELECT tree, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top(level, pos, n, digest) AS (SELECT 0, pos, n, digest FROM s
  UNION ALL SELECT level + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 16),
runs AS (SELECT tree, level, pos, coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM up WHERE n > 1
  UNION ALL SELECT '', level, pos, coalesce(string_agg(digest, '') OVER (PARTITION BY level, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''),
    coalesce(string_agg(digest, '') OVER (PARTITION BY level, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') FROM top WHERE n > 1),
a(id, tree, level, pos, own, proof) AS (SELECT pos, tree, 0, pos, coalesce(other, leaf), '' FROM d
  UNION ALL SELECT a.id, a.tree, a.level + 1, a.pos // 16, sha256(before || own || after), proof || before || after FROM a JOIN runs r ON a.tree = r.tree AND a.level = r.level AND a.pos = r.pos),
a_end AS (SELECT id, tree, arg_max(own, level) AS own, arg_max(proof, level) AS proof FROM a GROUP BY id, tree),
b(id, tree, level, pos, own, proof) AS (SELECT id, a_end.tree, 0, s.pos, own, proof FROM a_end JOIN s ON a_end.tree = s.tree
  UNION ALL SELECT b.id, b.tree, b.level + 1, b.pos // 16, sha256(before || own || after), proof || before || after FROM b JOIN runs r ON r.tree = '' AND b.level = r.level AND b.pos = r.pos),
b_end AS (SELECT id, tree, arg_max(own, level) AS folded_root, sha256(arg_max(proof, level)) AS proof_sha256 FROM b GROUP BY id, tree)
SELECT d.doc_id, d.leaf, s.digest AS subroot, top.digest AS root, b_end.proof_sha256, b_end.folded_root, b_end.folded_root = top.digest AS verified
FROM d JOIN s ON d.tree = s.tree JOIN b_end ON b_end.tree = d.tree AND b_end.id = d.pos JOIN top ON top.n = 1"""


QUERIES = {"op11_merkle": op11_merkle}
ORACLES = {"op11_merkle": _sql()}
