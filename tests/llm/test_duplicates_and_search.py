"""Near duplicates, top-k search and chroma against brute force."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tracewright.llm import chroma, components, near_duplicates as nd, top_k


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(doc, least.get(root(i), doc))
    return [(doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(rows)]


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 120))] for _ in range(40)]
    rows = []
    for b in base:
        for _ in range(rng.randint(1, 6)):
            c = list(b)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                c[rng.randrange(len(c))] = rng.choice(words)
            rows.append(" ".join(c))
    rows += [None, "", "  \t\n", "one", "ONE", "one two", "a b c d", "a b c d", " ", "Ä b", "x " * 30_000]
    rng.shuffle(rows)
    return [(1000 - i, t) for i, t in enumerate(rows)]


def test_near_duplicates_against_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, component_id string").repartition(5)
    for k in (4, 5):
        found = nd.near_duplicates(df, words=k).select("id", "n", "component_id").collect()
        assert sorted(map(tuple, found)) == sorted(brute_components(rows, k))


def test_near_duplicates_of_the_documents(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = nd.op10_near_duplicates(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == sorted(brute_components(docs, 4))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_near_duplicates_of_odd_ids_and_nothing(spark):
    df = spark.createDataFrame([(None, "same text of five words"), (7, "same text of five words"), (7, "same text of five words"), (None, None)], "doc_id long, text string")
    rows = nd.near_duplicates(df).collect()
    assert sorted(r["component_id"] or -1 for r in rows) == [-1, 7, 7, 7]
    assert nd.one_of_each(df).count() == 2
    assert nd.near_duplicates(df.limit(0)).isEmpty()


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 50), (None, 3), (60, 61), (61, 60)], "u long, v long")
    found = {r["node"]: r["component"] for r in components.connected_components(e).collect()}
    assert found == {**{i: 0 for i in range(31)}, 60: 60, 61: 60}


def brute_top(rows, k):
    out = []
    for q, x in rows:
        if q % 3 == 0:
            s = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in rows if i != q and len(y) == len(x))
            out += [(q, r, i, -n) for r, (n, i) in enumerate(s[:k], 1)]
    return out


def test_top_k_with_ties_and_unsound_vectors(spark, monkeypatch):
    monkeypatch.setattr(top_k, "PAGE", 8)
    monkeypatch.setattr(top_k, "BLOCK", 64)
    rng = np.random.default_rng(1)
    good = [(int(i), [int(v) for v in rng.integers(-3, 4, 4)]) for i in rng.permutation(300)]
    good += [(1000 + i, [1, 1, 1, 1]) for i in range(40)] + [(2001, [5, 5]), (2004, [1, 2])]
    bad = [(3000, None), (3003, [None, 1.0, 1.0, 1.0]), (3006, [float("nan")] * 4), (3009, [float("inf"), 0.0, 0.0, 0.0]), (3012, []), (None, [9.0] * 4)]
    df = spark.createDataFrame([(i, [v / 1024 + 0.0001 for v in x]) for i, x in good] + bad + [(1000, [1 / 1024 + 0.0001] * 4)], "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    found = top_k.top_k(df, F.col("id") % 3 == 0, k=10)
    assert sorted(map(tuple, found.select("query_id", "rank", "id", "score").collect())) == sorted(brute_top(good, 10))
    assert top_k.top_k(df.limit(0), F.col("id") % 3 == 0).isEmpty()


def test_chroma_aligns_a_shifted_recording():
    rng = np.random.default_rng(2)
    melody = list(rng.normal(0, 0.3, 64))
    sound, rate = chroma.play_vector(melody)
    whole, late = (chroma.fingerprint(chroma.chroma(x, rate)) for x in (sound, sound[5 * chroma.HOP :]))
    offset, hits, error = chroma.align(whole, late)
    assert offset == -5 and error == 0 and hits >= len(late)
    assert chroma.align(whole, np.zeros(0, np.uint32)) is None
    assert not len(chroma.fingerprint(chroma.chroma(np.zeros(10), rate)))


def test_chroma_search_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = [rng.normal(0, 0.3, 40).tolist() for _ in range(12)]
    media = [(i, base[i % 12][i // 12 :]) for i in range(48)] + [(100, None), (101, []), (102, base[0]), (103, [0.0] * 40), (104, [0.1] * 50)]
    prints = chroma.fingerprint_media(spark.createDataFrame(media, "vec_id long, embedding array<double>"), "vec_id", "embedding", chroma.play_vector)
    found = {(r["query"], r["other"]): (r["offset"], r["hits"]) for r in chroma.match_recordings(prints, F.col("id") % 4 == 0).collect()}
    own, asked = {}, set()
    for r in sorted(prints.filter("n > 0").collect(), key=lambda r: r["id"]):
        node, _ = own.setdefault(bytes(r["prints"]), (r["id"], 0))
        if r["id"] % 4 == 0:
            asked.add(node)
    each = {node: np.frombuffer(p, "<u4") for p, (node, _) in own.items()}
    want = {}
    for q in asked:
        for o in each:
            if o != q and (m := chroma.align(each[q], each[o])) and m[1] >= chroma.MIN_HITS and m[2] <= chroma.MAX_ERROR:
                want[q, o] = m[:2]
    assert want and found == want


def test_common_passages_take_no_texts_along(spark, sf_dir):
    """Texts that share much, but too little to be linked, tie each other's buckets and are gone before texts are fetched."""
    import random

    rng = random.Random(9)
    shared = [f"s{i}" for i in range(60)]
    rows = [(i, " ".join(shared + [f"u{i}x{k}" for k in range(30)])) for i in range(400)] + [(1000, " ".join(shared + [f"u7x{k}" for k in range(30)]) + " end")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    described = nd.describe(df, "doc_id", "text", 4, ()).cache()
    candidates = described.selectExpr("row AS node", "n", "sig", "text")
    tied = described.selectExpr("CAST(1 AS long) AS tie", "row AS component", "row AS node")
    close = {r["node"] for r in nd.plausible(tied, candidates, 80).collect()}
    same = {r["row"] for r in described.filter("id IN (7, 1000)").collect()}
    assert same <= close and len(close) < 40
    got = {r["id"]: r["component_id"] for r in nd.near_duplicates(df, words=4).collect()}
    assert got == {i: (7 if i == 1000 else i) for i, _ in rows}
