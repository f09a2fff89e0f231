"""Near duplicates: MinHash signatures, banding, signature verification, exact confirmation, components.

1. Texts with equal shingle sets form a class; one of them stands for it from here on.
2. A class has a signature of minima under many universal hashes. Classes that agree in a band meet in its bucket.
3. In each bucket, every class is paired with the smallest one. Pairs whose signatures agree well enough are confirmed on
   their full sets. The links give first components.
4. Buckets still tie different components together. Classes outside the largest component of such a tie are held
   against all others of the tie, block by block: by signature alone first, and those with a likely partner on full sets then.
5. Components of all links; the smallest id of each is its name.

No group is gathered in one task: buckets give minima and joins, stars are salted, ties are cut into blocks. Sides that hold
signatures or texts grow with the corpus and are marked for merge joins, so that small and large inputs have one plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright.llm.base import materialize, table
from tracewright.llm.components import connected_components
from tracewright.llm.shingles import mixed, shingle_set, similar

#: At similarity 0.8 all bands differ in 3 of a million pairs.
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
_RNG = np.random.default_rng(1997)
_A = (_RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_B = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)[:, None]
#: Signatures may agree in so much less than the similarity asked for: over 4 standard deviations.
SLACK = 0.15
#: Members of a star, of a tie with texts, and of a tie with signatures alone, in one block.
STAR_BLOCK, TIE_BLOCK, SIGNATURE_BLOCK = 400, 512, 4096
#: Of a broadcast that narrows texts down to candidates; beyond so many candidates it only narrows less.
SLOTS = 1 << 20


def signature(hashes: np.ndarray) -> np.ndarray:
    """The low 16 of the upper 32 bits of each minimum of (a * x + b) mod 2**64."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, (hashes[None, at : at + 512] * _A + _B).min(axis=1), out=least)
    return ((least >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16)


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """(rows, BANDS) keys that hold the number of their band."""
    parts = sigs.reshape(len(sigs), BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        key = mixed(key + parts[:, :, k])
    return key.view(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def describe(docs: DataFrame, id_col: str, text_col: str, words: int, carry: tuple[str, ...]) -> DataFrame:
    """(row, id, text, carried, n, h1, h2, sig) for each input row; h1 and h2 stand for the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                n, h1, h2, sig = [], [], [], []
                for text in b.column(2).to_pylist():
                    s = shingle_set(text, words)
                    n.append(len(s))
                    with np.errstate(over="ignore"):
                        h1.append(int(mixed(s).sum(dtype=np.uint64).astype(np.int64)))
                        h2.append(int(mixed(s * np.uint64(3) + np.uint64(1)).sum(dtype=np.uint64).astype(np.int64)))
                    sig.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary())], names=["row", "id", "text", "carried", "n", "h1", "h2", "sig"]
                )

    carried = F.struct(*carry) if carry else F.lit(None).cast("string")
    used = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), carried.alias("carried"))
    kinds = {f.name: f.dataType.simpleString() for f in used.schema}
    return used.mapInArrow(run, f"row long, id {kinds['id']}, text string, carried {kinds['carried']}, n long, h1 long, h2 long, sig binary")


def bucket_rows(classes: DataFrame) -> DataFrame:
    """(key, node): a row for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = band_keys(_matrix(b.column(1)))
                nodes = np.repeat(b.column(0).to_numpy(zero_copy_only=False), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nodes)], names=["key", "node"])

    return classes.select("node", "sig").mapInArrow(run, "key long, node long")


def pick(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of these nodes. A broadcast of at most SLOTS hashed slots first drops most others before their texts are shuffled."""
    slot = F.pmod(F.xxhash64("node"), F.lit(SLOTS)).cast("int")
    slots = nodes.select(slot.alias("_slot")).distinct()
    close = rows.withColumn("_slot", slot).join(F.broadcast(slots), "_slot", "left_semi").drop("_slot")
    return close.join(nodes.hint("merge"), "node", "left_semi")


def by_signature(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Keeps pairs (node, center) whose signatures, and sizes, leave room for the similarity."""
    least = percent / 100 - SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                agree = (_matrix(b.column(2)) == _matrix(b.column(3))).mean(axis=1)
                yield b.select([0, 1]).filter(pa.array(agree >= least))

    one = classes.select("node", F.col("n").alias("n1"), F.col("sig").alias("s1"))
    two = classes.select(F.col("node").alias("center"), F.col("n").alias("n2"), F.col("sig").alias("s2"))
    sized = pairs.join(one.hint("merge"), "node").join(two.hint("merge"), "center").filter(100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2"))
    return sized.select("node", "center", "s1", "s2").mapInArrow(run, "node long, center long")


def confirm_stars(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (node, center) confirmed on their full sets. Large stars are cut into blocks that each get the center's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, own = None, np.zeros(0, np.uint64)
        for b in batches:
            out: list[tuple[int, int]] = []
            for c, role, node, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if role == 0:
                    center, own = c, shingle_set(text, words)
                elif c == center and similar(shingle_set(text, words), own, percent):
                    out.append((node, c))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["node", "center"])

    sizes = pairs.groupBy("center").agg(F.ceil(F.count("*") / STAR_BLOCK).alias("_blocks"))
    salted = pairs.join(sizes, "center").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("_blocks"))).drop("_blocks")
    members = salted.join(texts.hint("merge"), "node").select("center", "salt", F.lit(1).alias("role"), "node", "text")
    centers = salted.select("center", "salt").distinct().join(texts.withColumnRenamed("node", "center").hint("merge"), "center")
    centers = centers.select("center", "salt", F.lit(0).alias("role"), F.col("center").alias("node"), "text")
    rows = centers.unionByName(members).repartition("center", "salt").sortWithinPartitions("center", "salt", "role")
    return rows.select("center", "role", "node", "text").mapInArrow(run, "node long, center long")


def tie_blocks(tied: DataFrame, facts: DataFrame, data: list[str], size: int) -> DataFrame:
    """(tie, x, y, role, data): a tie's classes outside its largest component, and all of its classes, each cut into blocks that meet pairwise.

    tied: (tie, component, node). facts: node and the rest of data, which come with every copy.
    """
    per = tied.groupBy("tie", "component").count()
    largest = per.groupBy("tie").agg(F.max(F.struct("count", "component"))["component"].alias("main"), F.sum("count").alias("all"), (F.sum("count") - F.max("count")).alias("rest"))
    largest = largest.select("tie", "main", F.ceil(F.col("all") / size).alias("ys"), F.ceil(F.col("rest") / (size // 2)).alias("xs"))
    rows = tied.join(largest, "tie").join(facts.hint("merge"), "node")
    block = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    x = rows.filter("component <> main").select("tie", F.pmod(block, F.col("xs")).alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("ys") - 1)).alias("y"), F.lit(0).alias("role"), *data)
    y = rows.select("tie", F.explode(F.sequence(F.lit(0).cast("long"), F.col("xs") - 1)).alias("x"), F.pmod(block, F.col("ys")).alias("y"), F.lit(1).alias("role"), *data)
    return x.unionByName(y)


def plausible(tied: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """Those rows of tied whose signature and size fit some class of the tie in another component. Texts stay where they are.

    Pages with much in common but too little to be linked tie many classes; hardly any of them gets past this.
    """
    least = percent / 100 - SLACK

    def run(group: pa.Table) -> pa.Table:
        role = group.column("role").to_numpy()
        parts = [group.filter(pa.array(role == k)) for k in (0, 1)]
        found: set[tuple[int, int]] = set()
        if all(p.num_rows for p in parts):
            comp, node, size = ([p.column(c).to_numpy() for p in parts] for c in ("component", "node", "n"))
            sig = [_matrix(p.column("sig")) for p in parts]
            for i in range(len(node[0])):
                fits = (comp[1] != comp[0][i]) & (100 * np.minimum(size[1], size[0][i]) >= percent * np.maximum(size[1], size[0][i]))
                other = np.flatnonzero(fits)
                hit = other[(sig[1][other] == sig[0][i]).mean(axis=1) >= least] if len(other) else other
                if len(hit):
                    found.add((int(comp[0][i]), int(node[0][i])))
                    found.update((int(comp[1][j]), int(node[1][j])) for j in hit)
        tie = group.column("tie").slice(0, 1).to_pylist() * len(found)
        return pa.table({"tie": pa.array(tie, pa.int64()), "component": pa.array([c for c, _ in found], pa.int64()), "node": pa.array([n for _, n in found], pa.int64())})

    groups = tie_blocks(tied, candidates.select("node", "n", "sig"), ["component", "node", "n", "sig"], SIGNATURE_BLOCK)
    return groups.groupBy("tie", "x", "y").applyInArrow(run, "tie long, component long, node long").distinct()


def confirm_ties(tied: DataFrame, candidates: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (u, v) between different components of a tie, confirmed on their full sets, a group for each pair of blocks.

    In a group, a component that has been linked is not tried again.
    """
    least = percent / 100 - SLACK
    groups = tie_blocks(tied, candidates, ["component", "node", "n", "sig", "text"], TIE_BLOCK)

    def run(group: pa.Table) -> pa.Table:
        role = group.column("role").to_numpy()
        parts = [group.filter(pa.array(role == k)) for k in (0, 1)]
        links: list[tuple[int, int]] = []
        if all(p.num_rows for p in parts):
            comp = [p.column("component").to_pylist() for p in parts]
            node = [p.column("node").to_pylist() for p in parts]
            size = [p.column("n").to_numpy() for p in parts]
            sig = [_matrix(p.column("sig")) for p in parts]
            text = [p.column("text") for p in parts]
            sets: list[dict] = [{}, {}]
            parent = {c: c for c in [*comp[0], *comp[1]]}

            def root(c: int) -> int:
                while parent[c] != c:
                    parent[c] = parent[parent[c]]
                    c = parent[c]
                return c

            def full(k: int, i: int) -> np.ndarray:
                if i not in sets[k]:
                    sets[k][i] = shingle_set(text[k][i].as_py(), words)
                return sets[k][i]

            for i in range(len(node[0])):
                agree = (sig[1] == sig[0][i]).mean(axis=1)
                fits = (agree >= least) & (100 * np.minimum(size[1], size[0][i]) >= percent * np.maximum(size[1], size[0][i]))
                found = np.flatnonzero(fits)
                for j in found[np.argsort(-agree[found], kind="stable")]:
                    if root(comp[0][i]) != root(comp[1][j]) and similar(full(0, i), full(1, j), percent):
                        parent[root(comp[0][i])] = root(comp[1][j])
                        links.append((node[0][i], node[1][j]))
        return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})

    return groups.groupBy("tie", "x", "y").applyInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(row, id, n, component, component_id) for each input row; n is the size of its shingle set.

    Rows whose shingle sets have 100 * intersection >= percent * union are linked; component_id is the smallest id that
    links reach. Null and empty texts, and those without words, are linked with nothing and are their own component
    (component is null there); null ids are never the smallest unless a component has no other. Rows with equal ids are rows
    of their own. row numbers the input rows of this call. Other columns are not read. An empty table gives an empty result.
    """
    return _decided(docs, id_col, text_col, words, percent, ())[1]


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: of each component the row with its smallest id, the first if there are several, and all rows without words.

    What stays is decided without texts, which are shuffled once, in the end.
    """
    rest = tuple(c for c in docs.columns if c not in (id_col, text_col))
    described, found = _decided(docs, id_col, text_col, words, percent, rest)
    named = found.filter(F.col("component").isNotNull() & F.col("id").eqNullSafe(F.col("component_id")))
    stays = named.groupBy("component").agg(F.min("row").alias("row")).select("row").union(found.filter(F.col("component").isNull()).select("row"))
    kept = described.select("row", "id", "text", "carried").join(stays, "row", "left_semi")
    return kept.select(F.col("id").alias(id_col), F.col("text").alias(text_col), *(F.col("carried")[c].alias(c) for c in rest)).select(*docs.columns)


def _decided(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, carry: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The rows as describe() gives them, and near_duplicates() of them, both read from the shared folder."""
    described = materialize(describe(docs, id_col, text_col, words, carry), "described")
    real = described.filter("n > 0")
    members = real.groupBy("h1", "h2", "n").agg(F.min("row").alias("node"), F.min("id").alias("least"))
    members = materialize(members, "classes")
    classes = materialize(real.join(members.select(F.col("node").alias("row")), "row").select(F.col("row").alias("node"), "n", "sig"), "signatures")
    buckets = bucket_rows(classes)
    shared = buckets.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("last")).filter("center < last").drop("last")
    stars = materialize(buckets.join(shared, "key").filter("node <> center").select("node", "center").distinct(), "stars")
    candidates = materialize(pick(real.select(F.col("row").alias("node"), "n", "sig", "text"), stars.select("node").union(stars.select("center")).distinct()), "candidates")
    texts = candidates.select("node", "text")
    likely = materialize(by_signature(stars, candidates, percent), "likely")
    links = materialize(confirm_stars(likely, texts, words, percent), "links")
    first = connected_components(links, "node", "center")

    def placed(df: DataFrame, node: str, to: str) -> DataFrame:
        found = df.join(first.select(F.col("node").alias(node), F.col("component").alias("_c")), node, "left")
        return found.withColumn(to, F.coalesce("_c", node)).drop("_c")

    bridges = placed(placed(stars, "node", "c1"), "center", "c2").filter("c1 <> c2").select("c1", "c2").distinct()
    ties = connected_components(bridges, "c1", "c2").select(F.col("node").alias("component"), F.col("component").alias("tie"))
    everyone = placed(candidates.select("node"), "node", "component")
    tied = materialize(everyone.join(ties, "component").select("tie", "component", "node"), "tied")
    close = materialize(plausible(tied, candidates, percent), "close")
    more = materialize(confirm_ties(close, candidates, words, percent), "more")
    final = connected_components(links.select(F.col("node").alias("u"), F.col("center").alias("v")).unionByName(more))

    named = members.join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(names, "component").select("h1", "h2", "n", "component_id", "component")
    rows = described.select("row", "id", "n", "h1", "h2").join(named, ["h1", "h2", "n"], "left")
    return described, materialize(rows.select("row", "id", "n", "component", F.coalesce("component_id", "id").alias("component_id")), "decided")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words=4)
    return found.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


QUERIES = {"op10_near_duplicates": op10_near_duplicates}
ORACLES: dict[str, str] = {}
