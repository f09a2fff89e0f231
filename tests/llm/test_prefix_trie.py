"""The prefix trie against SQL and against plain Python, with every size of subtrie, nulls, ties, repeats and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewright.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, key int, pos string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role.encode(), sha(f"{len(role.encode())}:{role}{text}"), role, text))
    convs = {c: [x[4:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(convs.get(c - c % 20, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
        ends[built[c]].append(c)
    kids = Counter(path[:-1] for path in members if path)
    leaves, saved = Counter(), Counter()
    for path, of in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += (len(of) - 1) * words
    return Counter((of[0], len(p), members[p[:-1]][0] if p else None, len(of), kids[p], leaves[p], saved[p], sha(",".join(map(str, ends[p])))) for p, of in members.items())


def run(spark, rows, limit=trie.LIMIT):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return Counter(tuple(r[n] for n in NAMES) for r in trie.prefix_trie(*trie.with_shared_heads(trie.turns_of(df)), limit).collect())


def some_rows():
    rng, rows = random.Random(2), []
    for conv in [*range(100, 190), 205, 206]:  # 200 is absent
        for t in range(rng.choice([1, 2, 3, 6])):
            rows.append((conv, t, "user" if t % 2 else None, rng.choice(["a b", "c", None, "d e f"]), 1, "x"))
    rows += [(c, t, "user", f"copy {t} of all", 1, "x") for c in range(300, 360) for t in range(5)]
    rows += [(400, t, "user", f"w {t % 3}", 1, "x") for t in range(150)] + [(420, t, "user", f"w {t % 3}", 1, "x") for t in range(150)]
    rows += [(440, 1, "b", "tie", 1, "x"), (440, 1, "a", "tie", 1, "x"), (440, 1, "a", "tie", 1, "x"), (440, None, "z", "first", 1, "x"), (None, 0, "user", "nobody's", 1, "x")]
    return rows


@pytest.mark.parametrize("limit", [20_000, 40, 1])
def test_against_plain_python(spark, limit):
    rows = some_rows()
    assert run(spark, rows, limit) == plain(rows)


def test_empty_and_turnless(spark):
    assert run(spark, []) == Counter()
    lonely = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(lonely, 0, "user", "goes", 1, "x")]
    assert run(spark, rows) == plain(rows) == Counter([(lonely, 0, None, 1, 0, 1, 0, sha(str(lonely)))])


def test_hashes_of_members_in_numeric_order(spark):
    ids = [*range(95, 12_000, 3), -5]
    df = spark.createDataFrame([(7, i) for i in ids] + [(8, 11), (8, 2)], "rep long, conv_id long").repartition(6)
    assert {r["rep"]: r["ends_sha256"] for r in trie.hashed_members(df).collect()} == {7: sha(",".join(map(str, sorted(ids)))), 8: sha("2,11")}


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf_dir}/conversations.parquet')")
    found = con.execute(trie.ORACLES["op12_prefix_trie"])
    names = [d[0] for d in found.description]
    got = trie.op12_prefix_trie(spark, sf_dir)
    assert sorted(names) == sorted(NAMES) == sorted(got.columns)
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == Counter(found.fetchall())
    assert got.filter(F.col("depth") == 0).count() == 1
