"""The Merkle manifest against plain Python trees: many sizes, nulls, ties, repeated rows, a large source, empty tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewright.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """Root, and each leaf's path of (before, after)."""
    paths, where, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for path, at in zip(paths, where, strict=True):
            run, own = level[at // 16 * 16 : at // 16 * 16 + 16], at % 16
            path.append(("".join(run[:own]), "".join(run[own + 1 :])))
        level = [h("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
        where = [w // 16 for w in where]
    return level[0], paths


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 300, 1000, 4095, 4096])
def test_traversal_of_a_block(n):
    leaves = [h(str(i)) for i in range(n)]
    root, paths = plain_tree(leaves)
    levels = merkle.height(n)
    assert merkle.root_of(leaves, levels) == root
    assert list(merkle.traverse(leaves, levels)) == paths


def test_short_last_block_goes_up_as_far_as_the_others():
    assert merkle.root_of(["a"], 3) == h(h(h("a")))
    assert list(merkle.traverse(["a"], 3)) == [[("", "")] * 3]


def test_a_treehash_holds_few_nodes():
    stack, most = merkle.Treehash(2), 0
    for i in range(4096):
        stack.feed(str(i))
        most = max(most, sum(map(len, stack.rows[:2])))
    assert most <= 2 * 15


def expected(rows, fields, at, lower):
    """rows: dicts. Per row: id, leaf, subroot, root, proof, folded, verified."""
    def part(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r):
        return h("".join(part(r[f]) for f in fields))

    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([leaf(r) for r in sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))]) for s in order}
    root, upper = plain_tree([trees[s][0] for s in order]) if order else (None, [])
    out = []
    for s, above in zip(order, upper, strict=True):
        rows_of = sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        for r, path in zip(rows_of, trees[s][1], strict=True):
            own = r
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None:
                own = r | {"text": "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"])}
            folded = leaf(own)
            for b, a in [*path, *above]:
                folded = h(b + folded + a)
            out.append((r["doc_id"], leaf(r), trees[s][0], root, h("".join(b + a for b, a in [*path, *above])), folded, folded == root))
    return out


def run(spark, rows, schema):
    df = spark.createDataFrame(rows, schema).repartition(5)
    return merkle.manifest(df, merkle.FIELDS, {"text": F.translate("text", merkle.UPPER, merkle.LOWER)}, merkle.fold_of("doc_id", 5) == 0)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, _pos int"


def test_manifest_with_nulls_ties_and_repeats(spark):
    rows = [(i % 40, [None, "", "b", "é", "B"][i % 5], None if i % 7 == 0 else "en", i if i % 3 else None, [None, "", "Text A", "straße Z😀", "x" * 20_000][i % 5 if i % 4 else i % 3], "clash", i) for i in range(300)]
    rows += [(None, "b", "en", 1, "No Id", "", 0), (None, None, None, None, None, "", 0)] + [(5, "b", "en", 1, "Same", "", 0)] * 70
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    want = expected([dict(zip(names, r, strict=True)) for r in rows], merkle.FIELDS, "source", True)
    got = Counter(map(tuple, run(spark, rows, SCHEMA).collect()))
    assert got == Counter(want) and {v[-1] for v in got} == {True, False}


def test_source_of_several_blocks_and_many_sources(spark):
    rows = [(i, "hot", "en", i, f"Text {i}", "", 0) for i in range(9000)] + [(i, f"s{i}", "en", i, "T", "", 0) for i in range(9000, 9600)]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    want = expected([dict(zip(names, r, strict=True)) for r in rows], merkle.FIELDS, "source", True)
    assert sorted(map(tuple, run(spark, rows, SCHEMA).collect())) == sorted(want)


def test_paths_lead_to_the_root(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}", "en", 1, str(i), "", 0) for i in range(500)], SCHEMA)
    for r in merkle.authentication_paths(df, merkle.FIELDS).collect():
        own = r["leaf"]
        for step in r["path"]:
            own = h(step["before"] + own + step["after"])
        assert own == r["root"]


def test_empty_table(spark):
    assert run(spark, [], SCHEMA).collect() == []


def test_one_row(spark):
    got = run(spark, [(1, "a", None, None, "x", "", 0)], SCHEMA).collect()[0]
    assert got["leaf"] == got["subroot"] == got["root"] and got["proof_sha256"] == h("") and got["verified"]


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    found = con.execute(merkle.ORACLES["op11_merkle"])
    names = [d[0] for d in found.description]
    assert sorted(map(tuple, merkle.op11_merkle(spark, sf_dir).select(*names).collect())) == sorted(found.fetchall())
