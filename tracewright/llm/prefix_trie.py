"""Trie of conversation prefixes: what conversations share from their first turn on.

Turns are known by the digest of role and text. Equal conversations become one with a weight. Subtries are dealt by the digest of
their first turn, and those of at most LIMIT turns are built in applyInPandas with dictionaries of pointers to children, counted up
in an iterative postorder. A larger subtrie becomes a node of its own, and what follows is dealt again by the next turn, round by
round; a single conversation of more turns needs no trie and is counted with a running sum. From the deepest round up, the nodes
that were dealt again sum what their children have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tracewright.llm.base import WORD, crc32_sql, fold_of, materialize, table
from tracewright.llm.order import joined, numbered

#: Turns of a subtrie that one task builds; about as many lie in a group.
LIMIT = 20_000
#: Ids that are joined to one text before they are hashed in order.
CHUNK = 4096
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ending long, above string"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), n (turns of the conversation), key (digest of role and text) and words.

    Turns go by turn (null first), equal ones by role, then by key. Null roles and texts are empty. Rows without conv_id belong to no
    conversation. Other columns are not read.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    picked = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", role.alias("role"), key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return numbered(picked, ["conv_id"], ["turn", "role", "key"], "trie-turns").select("conv_id", F.col("_pos").alias("pos"), F.col("_n").alias("n"), "key", "words")


def with_shared_heads(turns: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id) and turns (conv_id, pos, key, words) where each conversation c takes its first h turns from c - c % every.

    h is crc32 of the id modulo heads; where that conversation is shorter or absent, all or none are taken. c's own first h turns go.
    """
    convs = turns.groupBy("conv_id").agg(F.max("n").alias("n")).withColumns({"h": fold_of("conv_id", heads), "of": F.col("conv_id") - F.col("conv_id") % every})
    lengths = convs.select(F.col("conv_id").alias("of"), F.col("n").alias("of_n"))
    convs = materialize(convs.join(lengths, "of", "left").select("conv_id", "h", "of", F.least("h", F.coalesce("of_n", F.lit(0))).alias("taken")), "trie-convs")
    first = turns.filter(F.col("pos") < heads - 1).select(F.col("conv_id").alias("of"), "pos", "key", "words")
    taken = convs.filter("taken > 0").join(first, "of").filter("pos < h").select("conv_id", "pos", "key", "words")
    short = convs.filter("taken < h").select("conv_id", (F.col("taken") - F.col("h")).alias("by"))  # only behind these do turns move
    own = turns.filter(F.col("pos") >= fold_of("conv_id", heads)).join(short, "conv_id", "left")
    own = own.select("conv_id", (F.col("pos") + F.coalesce("by", F.lit(0))).alias("pos"), "key", "words")
    return convs.select("conv_id"), materialize(taken.unionByName(own), "trie-rebuilt")


def classes_of(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal conversations: per class rep (smallest id), members and n (turns); and conv_id, rep of those in classes of several.

    Conversations are equal if three 64-bit sums of their turns' digests with their places are, and their lengths.
    """
    marks = {f"f{k}": F.bit_xor(F.xxhash64(F.lit(k), "pos", "key")) for k in range(3)}
    sums = turns.groupBy("conv_id").agg(F.count("*").alias("n"), *[f.alias(c) for c, f in marks.items()])
    known = ["n", *marks]
    marked = materialize(convs.join(sums, "conv_id", "left").fillna(0, known), "trie-marks")
    classes = materialize(marked.groupBy(*known).agg(F.min("conv_id").alias("rep"), F.count("*").alias("members")), "trie-classes")
    several = classes.filter("members > 1").select(*known, "rep")
    return classes.select("rep", "members", "n"), marked.join(several, known).select("conv_id", "rep")


def hashed_members(members: DataFrame) -> DataFrame:
    """rep and ends_sha256: hash of the decimal ids of each class in ascending order, joined by commas.

    Ids are dealt by range and joined to chunks there, however large a class is; a hash is a chain, so the chunks of a class then
    stream through one, of which no more than its state and a batch is held.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, waiting = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([waiting[0]], pa.int64()), pa.array([",".join(map(str, waiting))], pa.string())], names=["rep", "first", "ids"])

        for batch in batches:
            for rep, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if waiting and (rep != last or len(waiting) == CHUNK):
                    yield out()
                    waiting = []
                last = rep
                waiting.append(conv)
        if waiting:
            yield out()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done = []
            for rep, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if rep != last:
                    done += [(last, state.hexdigest())] if state else []
                    last, state = rep, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["rep", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["rep", "ends_sha256"])

    dealt = members.select("rep", "conv_id").repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id")
    parts = dealt.mapInArrow(chunks, "rep long, first long, ids string").repartition("rep").sortWithinPartitions("rep", "first")
    return parts.mapInArrow(hashes, "rep long, ends_sha256 string")


def build_tries(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of some subtries. rows: sub, conv_id, pos, key, words, n, members, depth (of the node above), above, above_conv."""
    rows = rows.sort_values(["conv_id", "pos"], kind="stable")
    tops: dict[str, int] = {}
    kids, parent, facts = [], [], []  # facts: conv_id, depth, n_convs, words, ending, above, above_conv
    at, last = -1, None
    for sub, conv, pos, key, words, n, members, depth, above, above_conv in zip(*(rows[c].tolist() for c in ("sub", "conv_id", "pos", "key", "words", "n", "members", "depth", "above", "above_conv")), strict=True):
        pointers, name, source = (tops, sub, -1) if conv != last else (kids[at], key, at)
        if (found := pointers.get(name)) is None:
            found = pointers[name] = len(kids)
            kids.append({})
            parent.append(source)
            facts.append([conv, pos + 1, 0, words, None, above if source < 0 else None, above_conv if source < 0 else facts[source][0]])
        at, last = found, conv
        facts[at][2] += members
        if pos + 1 == n:
            facts[at][4] = conv
    leaves, saved = [0] * len(kids), [0] * len(kids)
    for top in tops.values():
        stack = [(top, iter(kids[top].values()))]
        while stack:
            node, rest = stack[-1]
            if (child := next(rest, None)) is not None:
                stack.append((child, iter(kids[child].values())))
                continue
            stack.pop()
            leaves[node] = leaves[node] or 1
            saved[node] += (facts[node][2] - 1) * facts[node][3]
            if (up := parent[node]) >= 0:
                leaves[up] += leaves[node]
                saved[up] += saved[node]
    return pd.DataFrame(
        {
            "conv_id": [f[0] for f in facts], "depth": [f[1] for f in facts], "parent_conv_id": [f[6] for f in facts], "n_convs": [f[2] for f in facts],
            "n_children": list(map(len, kids)), "n_leaves": leaves, "saved_tokens": saved, "ending": pd.array([f[4] for f in facts], "Int64"), "above": [f[5] for f in facts],
        }
    )


def chain_nodes(rows: DataFrame) -> DataFrame:
    """The nodes of subtries of one class alone: a running sum from the last turn back, of which Spark spills what is large."""
    behind = F.sum(F.col("words")).over(Window.partitionBy("conv_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0))
    top = F.col("pos") == F.col("depth")
    return rows.select(
        "conv_id", (F.col("pos") + 1).alias("depth"), F.when(top, F.col("above_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.col("members").alias("n_convs"),
        F.when(F.col("pos") + 1 < F.col("n"), 1).otherwise(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("members") - 1) * behind).alias("saved_tokens"),
        F.when(F.col("pos") + 1 == F.col("n"), F.col("conv_id")).alias("ending"), F.when(top, F.col("above")).alias("above"),
    )


def prefix_trie(convs: DataFrame, turns: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The nodes of the trie of convs (conv_id, distinct) by their turns (conv_id, pos from 0, key, words).

    One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256
    (of the members that end there). Conversations without turns end at the root. Without conversations there is no node.
    """
    classes, members = classes_of(convs, turns)
    spark = convs.sparkSession
    total = classes.agg(F.sum("members").alias("n_convs"), F.min("rep").alias("conv_id"), F.min(F.when(F.col("n") == 0, F.col("rep"))).alias("ending")).first()
    if total["n_convs"] is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    reps = classes.filter("n > 0").withColumnRenamed("rep", "conv_id")
    rows = turns.join(reps, "conv_id").select("conv_id", "pos", "key", "words", "n", "members", F.lit("").alias("node"), F.lit(total["conv_id"]).cast("long").alias("node_conv"))
    large = [spark.createDataFrame([("", None, total["conv_id"], None, total["n_convs"], 0, total["ending"])], "node string, above string, conv_id long, above_conv long, n_convs long, words long, ending long")]
    done, depth = [], 0
    while True:
        rows = materialize(rows, "trie-rows")
        first = rows.filter(F.col("pos") == depth).withColumn("sub", F.sha2(F.concat("node", "key"), 256))
        sizes = first.groupBy("sub").agg(
            F.sum(F.col("n") - depth).alias("size"), F.count("*").alias("reps"), F.sum("members").alias("n_convs"), F.min("conv_id").alias("first_conv"), F.max("words").alias("own_words"),
            F.max(F.when(F.col("n") == depth + 1, F.col("conv_id"))).alias("ending"), F.first("node").alias("above"), F.first("node_conv").alias("above_conv"),
        )
        kind = F.when(F.col("size") <= limit, "small").when(F.col("reps") == 1, "chain").otherwise("large")
        sizes = materialize(sizes.withColumn("kind", kind), "trie-sizes")
        named = first.select("conv_id", "sub").join(sizes.select("sub", "kind", "first_conv"), "sub")
        dealt = materialize(rows.join(named, "conv_id"), "trie-dealt")
        fixed = dealt.select("sub", "kind", "conv_id", "pos", "key", "words", "n", "members", F.lit(depth).cast("long").alias("depth"), F.col("node").alias("above"), F.col("node_conv").alias("above_conv"))
        counted = {r["kind"]: r["rows"] for r in sizes.groupBy("kind").agg(F.sum("size").alias("rows")).collect()}
        if small := counted.get("small"):
            groups = int(small // limit + 1) * 4
            done.append(materialize(fixed.filter("kind = 'small'").groupBy(F.pmod(F.xxhash64("sub"), F.lit(groups)).alias("group")).applyInPandas(build_tries, NODE), "trie-nodes"))
        if counted.get("chain"):
            done.append(materialize(chain_nodes(fixed.filter("kind = 'chain'")), "trie-nodes"))
        if not counted.get("large"):
            break
        large.append(sizes.filter("kind = 'large'").select(F.col("sub").alias("node"), "above", F.col("first_conv").alias("conv_id"), "above_conv", "n_convs", F.col("own_words").alias("words"), "ending"))
        depth += 1
        rows = dealt.filter((F.col("kind") == "large") & (F.col("pos") >= depth)).select("conv_id", "pos", "key", "words", "n", "members", F.col("sub").alias("node"), F.col("first_conv").alias("node_conv"))
    nodes = reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], NODE)
    tops = nodes.filter("above IS NOT NULL").select("above", "n_leaves", "saved_tokens")
    for level in range(len(large) - 1, -1, -1):  # tops of other levels match no node here
        sums = tops.groupBy("above").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved")).withColumnRenamed("above", "node")
        own = large[level].join(sums, "node", "left").select(
            "conv_id", F.lit(level).cast("long").alias("depth"), F.col("above_conv").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
            (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"), "ending", "above",
        )
        own = materialize(own, "trie-nodes")
        nodes, tops = nodes.unionByName(own), tops.unionByName(own.select("above", "n_leaves", "saved_tokens")) if level else tops
    hashed = hashed_members(members).withColumnRenamed("rep", "ending")
    ends = F.coalesce("ends_sha256", F.when(F.col("ending").isNotNull(), F.sha2(F.col("ending").cast("string"), 256)), F.sha2(F.lit(""), 256))
    return nodes.join(hashed, "ending", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends.alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*with_shared_heads(turns_of(table(spark, sf_dir, "conversations"))))


_SQL = rf"""
WITH ids AS (SELECT DISTINCT conv_id AS c, {crc32_sql("conv_id")} % 4 AS h FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, turn, coalesce(role, '') AS role, sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
  len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS words FROM conversations),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, key) - 1 AS pos FROM k),
r0 AS (SELECT c, 0 AS part, pos, key, words FROM ids JOIN t ON t.conv_id = c - c % 20 AND pos < h
  UNION ALL SELECT c, 1, pos, key, words FROM ids JOIN t ON t.conv_id = c AND pos >= h),
r AS (SELECT c, key, words, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d FROM r0),
p AS (SELECT c, d, words, sha256(string_agg(key, '') OVER (PARTITION BY c ORDER BY d)) AS path FROM r UNION ALL SELECT c, 0, 0, '' FROM ids),
n AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM p GROUP BY path, d),
ends AS (SELECT path, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS h FROM (SELECT path, c, d = max(d) OVER (PARTITION BY c) AS last FROM p) WHERE last GROUP BY path),
u AS (SELECT n.*, q.path AS above FROM n LEFT JOIN p q ON q.c = n.conv_id AND q.d = n.d - 1),
kids AS (SELECT above, count(*) AS n_children FROM u WHERE above IS NOT NULL GROUP BY above),
f AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN kids ON kids.above = u.path),
s AS (SELECT q.path, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.words) AS saved_tokens FROM f JOIN p q ON q.c = f.conv_id AND q.d <= f.d GROUP BY q.path)
SELECT f.conv_id, f.d::BIGINT AS depth, a.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, coalesce(ends.h, sha256('')) AS ends_sha256
FROM f JOIN s ON s.path = f.path LEFT JOIN ends ON ends.path = f.path LEFT JOIN n a ON a.path = f.above"""

QUERIES = {"op12_prefix_trie": op12_prefix_trie}
ORACLES = {"op12_prefix_trie": _SQL}
