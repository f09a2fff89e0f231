"""Tree ensembles: held-out figures, weights, gradients, partitioning; Shapley values by brute force; stored models and search."""

import math
import random
from datetime import datetime
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright import catalog_models
from tracewright.lineage import written
from tracewright.operators import evaluation, model_store, trees

NAMES = ["a", "b", "c", "d"]
SCHEMA = "id long, a double, b double, c double, d double, y int, _w string"


def some_rows(n=600, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        a, b, c = rng.random(), rng.choice([0.0, 1.0, 2.0, None]), rng.gauss(0, 1)
        y = int((a > 0.5) != (c > 0) if rng.random() < 0.95 else rng.random() < 0.5)
        rows.append((i if i % 50 else None, a, b, c if i % 40 else float("nan"), 7.0, y if i % 33 else None, "clash"))
    return rows


@pytest.fixture(scope="module")
def learned(spark):
    rows = spark.createDataFrame(some_rows(), SCHEMA).repartition(5)
    learn, cuts = trees.prepared(rows, "id", NAMES, F.col("y")), trees.cuts_of(rows, NAMES)
    models = {"boosting": trees.fit_boosting(learn, NAMES, cuts, 4, 3), "forest": trees.fit_forest(learn, NAMES, cuts, 6, 3)}
    return rows, learn, cuts, models


def test_learns_an_interaction_and_gives_importance(spark, learned):
    rows, _, _, models = learned
    held = spark.createDataFrame(some_rows(seed=2), SCHEMA)
    scored = trees.scored(held, "id", models)
    assert scored.count() == 600 and scored.filter("vote IS NULL OR vote < 0 OR vote > 1").isEmpty()
    pairs = [(trees.binned(pd.DataFrame([r[1:5]], columns=NAMES), NAMES, models["boosting"].cuts), r[5]) for r in some_rows(seed=2) if r[5] is not None]
    right = np.mean([(models["boosting"].probability(b)[0] >= 0.5) == y for b, y in pairs])
    assert right > 0.85
    for m in [models, {"boosting": models["boosting"]}]:
        shares = trees.importances(m)
        assert abs(sum(shares.values()) - 1) < 1e-9 and shares["a"] + shares["c"] > 0.7 and shares["d"] == 0
    factors = trees.risk_factors(rows, "id", models)
    assert factors.filter("value <= 0 OR importance <= 0.01 OR feature = 'd'").isEmpty() and factors.count() > 0


def test_same_model_under_any_partitioning(spark, learned):
    rows, _, cuts, models = learned
    again = trees.prepared(rows.repartition(2, "a"), "id", NAMES, F.col("y"))
    assert trees.fit_boosting(again, NAMES, cuts, 4, 3).json() == models["boosting"].json()
    assert trees.fit_forest(again, NAMES, cuts, 6, 3).json() == models["forest"].json()
    assert trees.Model.of(models["forest"].json()) == models["forest"]


def test_a_weight_counts_as_so_many_rows(spark, learned):
    rows, _, cuts, _ = learned
    weighted = trees.prepared(rows, "id", NAMES, F.col("y"), F.when(F.col("y") == 1, 3.0).otherwise(1.0))
    repeated = trees.prepared(rows.withColumn("k", F.explode(F.when(F.col("y") == 1, F.array(*map(F.lit, (1, 2, 3)))).otherwise(F.array(F.lit(1))))), "id", NAMES, F.col("y"))
    one, two = trees.fit_boosting(weighted, NAMES, cuts, 2, 2), trees.fit_boosting(repeated, NAMES, cuts, 2, 2)
    assert [t.feature for t in one.trees] == [t.feature for t in two.trees] and [t.bin for t in one.trees] == [t.bin for t in two.trees]
    assert np.allclose([v for t in one.trees for v in t.value], [v for t in two.trees for v in t.value], atol=1e-4)
    assert trees.class_weight(rows.filter("y = 0"), F.col("y")) == 10.0


def test_gradients_against_differences():
    rng = np.random.default_rng(4)
    y, w, raw, e = (rng.random(50) > 0.5).astype(float), rng.random(50) + 0.1, rng.normal(size=50), 1e-4
    loss = lambda r: w * (np.log1p(np.exp(r)) - y * r)
    g, h = trees.gradients("boosting", y, w, raw)
    assert np.allclose(g, (loss(raw + e) - loss(raw - e)) / (2 * e), atol=1e-6)
    assert np.allclose(h, (loss(raw + e) - 2 * loss(raw) + loss(raw - e)) / e**2, atol=1e-5)


def test_best_split_against_all_splits():
    rng = np.random.default_rng(5)
    for _ in range(30):
        hist = np.stack([rng.normal(size=(3, 6)), rng.random((3, 6)), rng.integers(0, 4, (3, 6))], axis=2)
        hist[..., :2] *= hist[..., 2:] > 0
        hist[1:, 0] += hist[0].sum(axis=0) - hist[1:].sum(axis=1)  # the same rows under each feature
        score = lambda s: s[0] ** 2 / (s[1] + 1 + 1e-12)
        options = []
        for f in range(3):
            for b in range(5):
                left, right = hist[f, : b + 1].sum(axis=0), hist[f, b + 1 :].sum(axis=0)
                if min(left[1], right[1]) >= 0.2 and min(left[2], right[2]) > 0:
                    options.append((score(left) + score(right) - score(hist[f].sum(axis=0)), f, b))
        found, best = trees.best_split(hist, [0, 1, 2], 1.0, 0.2), max(options, default=None)
        if best is None or best[0] <= 1e-9:
            assert found is None
        else:
            assert abs(found[0] - best[0]) < 1e-9 and found[0] in [pytest.approx(g) for g, f, b in options if (f, b) == found[1:]]


def expectation(tree, row, known, node=0):
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    left, right = tree.left[node], tree.right[node]
    if f in known:
        return expectation(tree, row, known, left if row[f] <= tree.bin[node] else right)
    return sum(tree.cover[c] / tree.cover[node] * expectation(tree, row, known, c) for c in (left, right))


@pytest.mark.parametrize("kind", ["boosting", "forest"])
def test_shapley_values_by_brute_force(learned, kind):
    model, n = learned[3][kind], len(NAMES)
    bins = trees.binned(pd.DataFrame([r[1:5] for r in some_rows(40, 9)], columns=NAMES), NAMES, model.cuts)
    base, found = trees.contributions(model, bins)
    scale, start = (1, model.base) if kind == "boosting" else (1 / len(model.trees), 0.0)
    value = lambda row, known: start + scale * sum(expectation(t, row, known) for t in model.trees)
    for row, got in zip(bins, found, strict=True):
        for f in range(n):
            others = [x for x in range(n) if x != f]
            want = sum(math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) * (value(row, {*s, f}) - value(row, set(s))) for k in range(n) for s in combinations(others, k))
            assert abs(want - got[f]) < 1e-9
    assert np.allclose(base + found.sum(axis=1), model.raw(bins))


def test_explained_rows_add_up(learned):
    rows, _, _, models = learned
    parts = trees.explained(rows.filter("id IS NOT NULL"), "id", models["boosting"]).groupBy("id").agg(F.sum("contribution").alias("s"), F.first("base").alias("b"), F.first("raw").alias("r"), F.count("*").alias("n"))
    assert parts.filter((F.abs(F.col("s") + F.col("b") - F.col("r")) > 1e-9) | (F.col("n") != 4)).isEmpty()


def test_nothing_and_one_class(spark, learned):
    rows, _, cuts, _ = learned
    none = trees.prepared(rows.filter("false"), "id", NAMES, F.col("y"))
    empty = trees.fit_boosting(none, NAMES, [[]] * 4)
    assert empty.trees == [] and trees.scored(rows, "id", {"m": empty}).filter("m <> 0.5").isEmpty()
    assert trees.fit_forest(none, NAMES, [[]] * 4, 2, 2).importance().tolist() == [0] * 4
    ones = trees.fit_boosting(trees.prepared(rows.filter("y = 1"), "id", NAMES, F.col("y")), NAMES, cuts, 2, 2)
    assert trees.scored(rows, "id", {"m": ones}).filter("m < 0.99").isEmpty()
    assert trees.cuts_of(rows.filter("false"), NAMES) == [[]] * 4 and trees.scored(rows.filter("false"), "id", {"m": ones}).count() == 0


def test_figures_against_plain_python(spark):
    rng = random.Random(6)
    rows = [(rng.choice([0, 1, 1, None]), rng.choice([0.1, 0.2, 0.5, 0.9, None, rng.random()]), 0.4) for _ in range(300)]
    got = {r["model"]: r for r in evaluation.figures(spark.createDataFrame(rows, "y int, p double, q double"), F.col("y"), ["p", "q"]).collect()}
    pairs = [(y, p) for y, p, _ in rows if y is not None and p is not None]
    yes, no = [p for y, p in pairs if y], [p for y, p in pairs if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in yes for b in no) / len(yes) / len(no)
    tp, said = sum(p >= 0.5 for p in yes), sum(p >= 0.5 for _, p in pairs)
    r = got["p"]
    assert r["n"] == len(pairs) and abs(r["auc"] - auc) < 1e-12 and r["precision"] == tp / said and r["recall"] == tp / len(yes)
    assert abs(r["log_loss"] + np.mean([math.log(p if y else 1 - p) for y, p in pairs])) < 1e-12 and abs(got["q"]["auc"] - 0.5) < 1e-12
    assert evaluation.figures(spark.createDataFrame([(1, 0.3)], "y int, p double"), F.col("y"), ["p"]).first()["auc"] is None


def test_store_choice_and_means(spark, tmp_path):
    store = f"{tmp_path}/models"
    assert model_store.listed(spark, store).count() == 0 and model_store.chosen(model_store.listed(spark, store)).count() == 0
    for name, kind, mode, day in (("a", "forest", "x", 1), ("b", "boosting", "x", 2), ("c", "boosting", "x", 2), ("d", "forest", "y", 3), ("e", "ensemble", "y", 1)):
        model_store.save(spark, store, name, kind, mode, datetime(2024, 1, day), {"f": 1.0}, "{}")
    model_store.save(spark, store, "a", "forest", "x", datetime(2024, 1, 5), {}, "new")
    ids = lambda df: [r["model_id"] for r in df.collect()]
    assert ids(model_store.latest(model_store.listed(spark, store), 3, "x")) == ["a", "b", "c"]
    assert ids(model_store.chosen(model_store.listed(spark, store), 2, "x")) == ["a", "b"] and ids(model_store.chosen(model_store.listed(spark, store), 2, "y")) == ["e"]
    assert model_store.delete(spark, store, "a") and not model_store.delete(spark, store, "a")
    assert sorted(ids(model_store.listed(spark, store))) == ["b", "c", "d", "e"]
    scores = model_store.mean_scores(spark.createDataFrame([(1, 0.9, 0.5), (2, None, 0.8), (3, None, None)], "id int, p double, q double"), "id", ["p", "q"])
    assert [(r["id"], r["score"], r["flagged"]) for r in scores.orderBy("id").collect()] == [(1, 0.7, True), (2, 0.8, True), (3, None, False)]
    members = spark.createDataFrame([("g", 1), ("g", 2), ("g", 3), ("h", 9)], "g string, id int")
    assert [(r["g"], round(r["score"], 9), r["n"]) for r in model_store.group_scores(scores, members, "g", "id").collect()] == [("g", 0.75, 2)]


def test_search_ranks_all_combinations():
    found = model_store.search({"a": [1, 2], "b": [3, 1]}, lambda a, b: a * b, lambda m: m)
    assert [(r["params"], r["rank"]) for r in found] == [('{"a": 1, "b": 3}', 3), ('{"a": 1, "b": 1}', 1), ('{"a": 2, "b": 3}', 4), ('{"a": 2, "b": 1}', 2)]


def test_held_out_documents_beat_the_prior(spark):
    got = {r["model"]: r for r in catalog_models.evaluated(spark, "/root/testdata/sf0.01").collect()}
    for name in ("forest", "boosting", "vote"):
        assert got[name]["auc"] > 0.75 and got[name]["n"] == got["prior"]["n"] > 50


def test_model_queries(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert catalog_models.tree_ensembles(spark, sf_dir).count() == docs
    assert abs(sum(r["importance"] for r in catalog_models.importance(spark, sf_dir).collect()) - 1) < 1e-9
    scores = written(catalog_models.ensemble_scores(spark, sf_dir))
    assert scores.filter("level = 'document'").count() == docs
    assert [r["rank"] for r in catalog_models.searched(spark, sf_dir).orderBy("rank").collect()] == [1, 2, 3, 4]
