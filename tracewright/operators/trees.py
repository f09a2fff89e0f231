"""Tree ensembles for two classes: histogram boosting, forests, soft voting, importance, contributions of features.

Rows stay where they are. For each level of a tree (of all trees of a forest at once), every task adds up the gradients of its rows by
node, feature and bin; Spark sums those, and the driver takes the best split of each node. What is collected has at most trees x nodes
x features x bins rows, whatever the table. Sums are of whole numbers (gradients in units of 2**-20), so that a model is the same
however the rows are partitioned.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tracewright.lineage import written

UNIT = 2.0**20
HIST = "tree int, node int, feature int, bin int, g long, h long, n long"
#: Shares of the Poisson distribution of mean 1, by which a forest draws rows with repeats.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


@dataclass
class Tree:
    """Nodes in the order in which they were made. A row goes left if its bin is at most `bin`; feature -1 is a leaf."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    cover: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int, gain: float, sides: list[tuple[float, int]]) -> None:
        self.feature[node], self.bin[node], self.gain[node] = feature, at, gain
        for name, (value, cover) in zip(("left", "right"), sides, strict=True):
            getattr(self, name)[node] = len(self.feature)
            for column, x in (("feature", -1), ("bin", 0), ("left", -1), ("right", -1), ("value", value), ("cover", cover), ("gain", 0.0)):
                getattr(self, column).append(x)

    def nodes_of(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            here = at[rows]
            at[rows] = np.where(bins[rows, feature[here]] <= cut[here], left[here], right[here])
        return at


@dataclass
class Model:
    """kind: boosting (base and trees add up to a logit) or forest (the mean of the trees is a probability)."""

    kind: str
    features: list[str]
    cuts: list[list[float]]
    base: float
    trees: list[Tree]

    def json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def of(text: str) -> Model:
        held = json.loads(text)
        return Model(**held | {"trees": [Tree(**t) for t in held["trees"]]})

    def bins(self, rows: pd.DataFrame) -> np.ndarray:
        return binned(rows, self.features, self.cuts)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        parts = [np.array(t.value)[t.nodes_of(bins)] for t in self.trees]
        total = np.sum(parts, axis=0) if parts else np.zeros(len(bins))
        return self.base + total if self.kind == "boosting" else total / max(1, len(parts))

    def probability(self, bins: np.ndarray) -> np.ndarray:
        raw = self.raw(bins)
        return 1 / (1 + np.exp(-raw)) if self.kind == "boosting" else np.clip(raw, 0, 1)

    def importance(self) -> np.ndarray:
        """Shares of the gain of all splits; they sum to 1, or are all 0 where nothing is split."""
        total = np.zeros(len(self.features))
        for t in self.trees:
            for f, g in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    total[f] += g
        return total / total.sum() if total.sum() > 0 else total


def binned(rows: pd.DataFrame, features: list[str], cuts: list[list[float]]) -> np.ndarray:
    """0 for null and NaN, then 1 and how many cuts are smaller."""
    out = np.empty((len(rows), len(features)), np.uint8)
    for k, (name, at) in enumerate(zip(features, cuts, strict=True)):
        x = rows[name].to_numpy(np.float64, na_value=np.nan)
        out[:, k] = np.where(np.isnan(x), 0, 1 + np.searchsorted(np.array(at), x, side="left"))
    return out


def cuts_of(rows: DataFrame, features: list[str], bins: int = 32) -> list[list[float]]:
    """At most bins - 2 quantiles of each feature; a feature without values has none."""
    shares = [k / (bins - 1) for k in range(1, bins - 1)]
    found = rows.agg(*[F.percentile_approx(F.when(~F.isnan(f), F.col(f)), shares, 10_000).alias(f) for f in features]).first()
    return [sorted(set(found[f] or [])) for f in features]


def prepared(rows: DataFrame, id_col: str, features: list[str], label: Column, weight: Column | None = None) -> DataFrame:
    """The rows to learn from, in the shared folder: features as doubles, _y (0 or 1), _w, _h (a hash of the id). Rows without a label go."""
    numbers = [F.col(f).cast("double").alias(f) for f in features]
    w = F.lit(1.0) if weight is None else weight.cast("double")
    return written(rows.select(*numbers, label.cast("double").alias("_y"), w.alias("_w"), F.xxhash64(F.col(id_col).cast("string")).alias("_h")).filter("_y IS NOT NULL AND _w > 0"))


def class_weight(rows: DataFrame, label: Column) -> float:
    """What a positive row weighs against a negative one, so that both classes weigh the same: 10 without positives."""
    r = rows.agg(F.sum(F.when(label == 0, 1)).alias("no"), F.sum(F.when(label == 1, 1)).alias("yes")).first()
    return (r["no"] or 0) / r["yes"] if r["yes"] else 10.0


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """Uniform numbers from 0 to 1 out of hashes, others for each seed."""
    with np.errstate(over="ignore"):
        x = h.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0**53


def gradients(kind: str, y: np.ndarray, w: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second of the weighted logistic loss by the logit; of a forest, weighted labels and weights."""
    if kind == "forest":
        return w * y, w
    p = 1 / (1 + np.exp(-raw))
    return w * (p - y), w * p * (1 - p)


def _histograms(rows: DataFrame, model: Model, grown: list[Tree], seed: int) -> dict[tuple[int, int], np.ndarray]:
    """(tree, node): features x bins x (g, h, n), of the open nodes of the trees that grow."""
    kind, widths = model.kind, max(len(c) for c in model.cuts) + 2

    def add_up(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n_nodes = max(len(t.feature) for t in grown)
        total = np.zeros((len(grown), n_nodes, len(model.features), widths, 3), np.int64)
        for part in parts:
            bins, y, w, h = model.bins(part), part["_y"].to_numpy(), part["_w"].to_numpy(), part["_h"].to_numpy()
            raw = model.raw(bins) if kind == "boosting" else None
            for k, tree in enumerate(grown):
                times = np.searchsorted(POISSON, _mixed(h, seed + k)) if kind == "forest" else np.ones(len(y), np.int64)
                g, hess = (np.rint(x * UNIT).astype(np.int64) for x in gradients(kind, y, w * times, raw))
                at = tree.nodes_of(bins)
                for f in range(len(model.features)):
                    for c, x in enumerate((g, hess, times)):
                        np.add.at(total[k, :, f, :, c], (at, bins[:, f]), x)
        k, node, f, b = np.nonzero(total.any(axis=4))
        yield pd.DataFrame({"tree": k.astype(np.int32), "node": node.astype(np.int32), "feature": f.astype(np.int32), "bin": b.astype(np.int32), **{c: total[k, node, f, b, i] for i, c in enumerate("ghn")}})

    summed = rows.mapInPandas(add_up, HIST).groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"])
    found: dict[tuple[int, int], np.ndarray] = {}
    for r in summed.collect():  # at most trees x nodes x features x bins
        found.setdefault((r["tree"], r["node"]), np.zeros((len(model.features), widths, 3)))[r["feature"], r["bin"]] = (r["g"] / UNIT, r["h"] / UNIT, r["n"])
    return found


def best_split(hist: np.ndarray, features: list[int], ridge: float, least: float) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the split that lowers the loss most; of equal ones, the first feature and bin."""
    best = None
    for f in features:
        left = np.cumsum(hist[f], axis=0)[:-1]
        whole = hist[f].sum(axis=0)
        right = whole - left
        good = (left[:, 1] >= least) & (right[:, 1] >= least) & (left[:, 2] > 0) & (right[:, 2] > 0)
        if good.any():
            gain = np.where(good, left[:, 0] ** 2 / (left[:, 1] + ridge + 1e-12) + right[:, 0] ** 2 / (right[:, 1] + ridge + 1e-12), -np.inf) - whole[0] ** 2 / (whole[1] + ridge + 1e-12)
            at = int(gain.argmax())
            if gain[at] > 1e-9 and (best is None or gain[at] > best[0] + 1e-12):
                best = (float(gain[at]), f, at)
    return best


def _grow(rows: DataFrame, model: Model, n: int, depth: int, ridge: float, least: float, rate: float, seed: int, some: int) -> list[Tree]:
    trees, opened = [Tree() for _ in range(n)], [{0} for _ in range(n)]
    value = (lambda g, h: -rate * g / (h + ridge)) if model.kind == "boosting" else (lambda g, h: g / h)
    for level in range(depth):
        if not any(opened):
            break
        hists = _histograms(rows, model, trees, seed)
        for k, tree in enumerate(trees):
            below = set()
            for node in sorted(opened[k]):
                if (hist := hists.get((k, node))) is None:
                    continue
                whole = hist[0].sum(axis=0)
                if level == 0:
                    tree.cover[0], tree.value[0] = int(whole[2]), value(whole[0], whole[1]) if whole[1] else 0.0
                order = np.random.default_rng([seed, k, node]).permutation(len(model.features)).tolist()
                if (found := best_split(hist, sorted(order[:some]), ridge, least)) is not None:
                    gain, f, at = found
                    left = hist[f][: at + 1].sum(axis=0)
                    tree.split(node, f, at, gain, [(value(s[0], s[1]), int(s[2])) for s in (left, whole - left)])
                    below |= {tree.left[node], tree.right[node]}
            opened[k] = below
    return trees


def fit_boosting(rows: DataFrame, features: list[str], cuts: list[list[float]], trees: int = 12, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, least: float = 1.0) -> Model:
    """rows: from prepared(). One pass for each level of each tree. Without rows the model says one half."""
    r = rows.agg(F.sum(F.col("_y") * F.col("_w")).alias("yes"), F.sum("_w").alias("all")).first()
    share = min(max((r["yes"] or 0.0) / r["all"], 1e-6), 1 - 1e-6) if r["all"] else 0.5
    model = Model("boosting", features, cuts, math.log(share / (1 - share)), [])
    for k in range(trees if r["all"] else 0):
        model.trees += _grow(rows, model, 1, depth, ridge, least, rate, k, len(features))
    return model


def fit_forest(rows: DataFrame, features: list[str], cuts: list[list[float]], trees: int = 16, depth: int = 5, least: float = 2.0, seed: int = 11) -> Model:
    """rows: from prepared(). One pass for each level of all trees; every node tries the square root of the features."""
    model = Model("forest", features, cuts, 0.0, [])
    some = max(1, round(math.sqrt(len(features))))
    model.trees = _grow(rows, model, trees, depth, 0.0, least, 1.0, seed, some)
    return model


def scored(rows: DataFrame, id_col: str, models: dict[str, Model]) -> DataFrame:
    """id_col, a probability for each model by its name, and vote, their mean. Rows with nulls are scored as any other."""
    names = sorted({f for m in models.values() for f in m.features})
    kind = rows.schema[id_col].dataType.simpleString()

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = {name: m.probability(m.bins(part)) for name, m in models.items()}
            yield pd.DataFrame({id_col: part["_id"], **found, "vote": np.mean(list(found.values()), axis=0)})

    picked = rows.select(F.col(id_col).alias("_id"), *[F.col(f).cast("double").alias(f) for f in names])
    return picked.mapInPandas(score, f"`{id_col}` {kind}, {', '.join(f'`{n}` double' for n in models)}, vote double")


def importances(models: dict[str, Model]) -> dict[str, float]:
    """Mean over the models of each feature's share of the gain."""
    features = next(iter(models.values())).features
    return dict(zip(features, np.mean([m.importance() for m in models.values()], axis=0).tolist(), strict=True))


def _leaves(tree: Tree) -> list[tuple[float, list[tuple[int, int, bool, float]]]]:
    """Each leaf's value and the steps to it: feature, bin, whether to the left, share of the node's rows that go there."""
    found, stack = [], [(0, [])]
    while stack:
        node, steps = stack.pop()
        if tree.feature[node] < 0:
            found.append((tree.value[node], steps))
            continue
        for side, left in ((tree.left[node], True), (tree.right[node], False)):
            stack.append((side, [*steps, (tree.feature[node], tree.bin[node], left, tree.cover[side] / tree.cover[node])]))
    return found


def contributions(model: Model, bins: np.ndarray) -> tuple[float, np.ndarray]:
    """Base value, and rows x features: Shapley values of model.raw, with features that are left out following the rows of training.

    A leaf's part in the expectation is its value times, for each feature on its path, 1 or 0 if the feature is known (does the row go
    there?) and the share of rows if it isn't; so its Shapley values need only the subsets of the features on its own path.
    """
    out, base = np.zeros((len(bins), len(model.features))), model.base if model.kind == "boosting" else 0.0
    scale = 1.0 if model.kind == "boosting" else 1 / max(1, len(model.trees))
    for tree in model.trees:
        for value, steps in _leaves(tree):
            goes: dict[int, np.ndarray] = {}
            share: dict[int, float] = {}
            for f, at, left, part in steps:
                here = (bins[:, f] <= at) == left
                goes[f] = goes[f] & here if f in goes else here
                share[f] = share.get(f, 1.0) * part
            base += scale * value * math.prod(share.values())
            n = len(goes)
            for f in goes:
                others, total = [x for x in goes if x != f], np.zeros(len(bins))
                for size in range(n):
                    weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                    for known in combinations(others, size):
                        rest = math.prod(share[x] for x in others if x not in known)
                        total += weight * rest * (np.logical_and.reduce([goes[x] for x in known]) if known else 1.0)
                out[:, f] += scale * value * total * (goes[f] - share[f])
    return base, out


def explained(rows: DataFrame, id_col: str, model: Model) -> DataFrame:
    """id_col, feature, value, contribution, base, raw: for each row and feature; base and the contributions of a row add up to raw."""
    kind, features = rows.schema[id_col].dataType.simpleString(), model.features

    def explain(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            bins = model.bins(part)
            base, found = contributions(model, bins)
            raw = model.raw(bins)
            for k, f in enumerate(features):
                yield pd.DataFrame({id_col: part["_id"], "feature": f, "value": part[f], "contribution": found[:, k], "base": base, "raw": raw})

    picked = rows.select(F.col(id_col).alias("_id"), *[F.col(f).cast("double").alias(f) for f in features])
    return picked.mapInPandas(explain, f"`{id_col}` {kind}, feature string, value double, contribution double, base double, raw double")


def risk_factors(rows: DataFrame, id_col: str, models: dict[str, Model], least: float = 0.01) -> DataFrame:
    """id_col, feature, value, importance: the features of each row that matter (importance over `least`) and are over 0."""
    known = [(f, x) for f, x in importances(models).items() if x > least]
    table = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), F.lit(x).alias("importance")) for f, x in known])) if known else None
    if table is None:
        return rows.select(id_col, F.lit(None).cast("string").alias("feature"), F.lit(0.0).alias("value"), F.lit(0.0).alias("importance")).filter("false")
    return rows.select(id_col, table.alias("r")).select(id_col, "r.*").filter("value > 0")
