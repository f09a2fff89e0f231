"""Extreme deviates, sandwiches and shared holdings against plain Python."""

import math
import random
import statistics
from collections import Counter, defaultdict

import pytest

from tracewright.functions.student import esd_critical, t_quantile
from tracewright.lineage import written
from tracewright.operators import fraud, matching, series


def test_student_quantiles_of_printed_tables():
    for tail, df, want in ((0.025, 10, 2.228139), (0.05, 1, 6.313752), (0.005, 30, 2.749996), (0.025, 1000, 1.962339), (0.1, 3, 1.637744)):
        assert t_quantile(tail, df) == pytest.approx(want, abs=2e-6)
    assert esd_critical(54, 1, 0.05) == pytest.approx(3.158794, abs=1e-5) and esd_critical(54, 10, 0.05) == pytest.approx(3.085, abs=1e-3)
    assert math.isinf(esd_critical(3, 2, 0.05))


def plain_esd(values, most, alpha):
    left, taken = dict(values), []
    for i in range(1, most + 1):
        if len(left) < 2 or (spread := statistics.stdev(left.values())) == 0:
            break
        mean = statistics.fmean(left.values())
        z, key = max(((round(abs(v - mean) / spread, 9), -k) for k, v in left.items()))
        taken.append((-key, i, z, esd_critical(len(values), i, alpha)))
        del left[-key]
    last = max((i for _, i, z, c in taken if z > c), default=0)
    return taken[:last]


def test_generalised_esd(spark):
    rng, rows = random.Random(5), []
    for key in ["a", "b", None, "flat", "two"]:
        n = {"flat": 8, "two": 2}.get(key, 60)
        for i in range(n):
            v = 3.0 if key == "flat" else rng.gauss(0, 1) + (rng.choice([9, 9.5, -12]) if key != "b" and i % 25 == 3 else 0)
            rows.append((key, i, v if i % 19 else None))
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(4)
    got = defaultdict(list)
    for r in series.generalised_esd(df, "k", "i", "v", 6, 0.05, written).collect():
        got[r["k"]].append((r["i"], r["round"], r["deviate"], r["critical"]))
    by = defaultdict(dict)
    for k, i, v in rows:
        if v is not None:
            by[k][i] = v
    want = {k: [(i, n, z, round(c, 9)) for i, n, z, c in plain_esd(v, 6, 0.05)] for k, v in by.items()}
    assert {k: sorted(v, key=lambda r: r[1]) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert any(len(v) >= 3 for v in want.values()) and series.generalised_esd(df.filter("false"), "k", "i", "v", 3, 0.05, written).isEmpty()


def test_sandwiches(spark):
    rng, rows = random.Random(6), []
    for place in range(160):
        rows.append((rng.choice([1, 2, None]), rng.choice("xy"), place, rng.choice([1, 2, 3, 4, None]), rng.choice(["buy", "sell", None])))
    got = {r["trader"]: (r["n"], r["victims"]) for r in matching.sandwiches(spark.createDataFrame(rows, "block long, pool string, place long, trader long, side string").repartition(3)).collect()}
    n, victims = Counter(), defaultdict(set)
    pools = defaultdict(list)
    for r in rows:
        if None not in r:
            pools[r[:2]].append(r[2:])
    for trades in pools.values():
        for pa, ta, sa in trades:
            for pb, tb, sb in trades:
                if ta == tb and pa < pb and sa != sb:
                    for pv, tv, sv in trades:
                        if pa < pv < pb and tv != ta and sv == sa:
                            n[ta] += 1
                            victims[ta].add(tv)
    assert got == {t: (n[t], len(victims[t])) for t in n}
    assert matching.sandwiches(spark.createDataFrame([], "block long, pool string, place long, trader long, side string")).isEmpty()


@pytest.mark.parametrize("least", [1, 3])
def test_overlapping_holders_with_a_token_that_all_hold(spark, least):
    rng = random.Random(7)
    rows = [(w, "all") for w in range(40)] + [(rng.randrange(40), f"t{rng.randrange(30)}") for _ in range(260)] + [(None, "all"), (3, None), (3, "all")]
    held = defaultdict(set)
    for w, t in rows:
        if w is not None and t is not None:
            held[w].add(t)
    want = {(a, b): len(held[a] & held[b]) for a in held for b in held if a < b and len(held[a] & held[b]) >= least}
    got = {(r["wallet1"], r["wallet2"]): r["common"] for r in matching.overlapping_holders(spark.createDataFrame(rows, "wallet long, token string").repartition(3), least).collect()}
    assert got == want


@pytest.mark.parametrize("hot", [1, 6, 1000])
def test_overlapping_holders_order_and_hot_tokens(spark, hot, monkeypatch):
    rng, sizes, real = random.Random(8), [], matching.written
    rows = {(f"w{rng.randrange(30)}", f"t{min(rng.randrange(60), rng.randrange(60))}") for _ in range(260)}
    held = defaultdict(set)
    for w, t in rows:
        held[w].add(t)
    want = {(a, b): len(held[a] & held[b]) for a in held for b in held if a < b and len(held[a] & held[b]) >= 3}
    monkeypatch.setattr(matching, "written", lambda df: (out := real(df), sizes.append(out.count()))[0])
    got = {(r["wallet1"], r["wallet2"]): r["common"] for r in matching.overlapping_holders(spark.createDataFrame(list(rows), "wallet string, token string"), 3, hot).collect()}
    assert got == want
    assert hot < 1000 or max(sizes) <= len(rows)  # holdings, not pairs


@pytest.mark.parametrize("seed", range(3))
def test_price_manipulation_counts_without_a_row_for_each_trade_between(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice([1, 2, None] if k % 40 == 0 else [1, 2]), rnd.choice("de"), rnd.choice([1, 2, 3, 4, 5, 6, None]), rnd.randrange(60), rnd.choice(["A", "B", "C", None]), rnd.choice("ABC")) for k in range(150)]
    df = spark.createDataFrame(rows, "block int, dex string, trader long, place long, bought string, sold string")
    n, victims = Counter(), defaultdict(set)
    for a in rows:
        for b in rows:
            if None not in (*a[:3], *a[4:]) and a[4] != a[5] and a[:3] == b[:3] and (a[4], a[5]) == (b[5], b[4]) and a[3] < b[3]:
                for m in rows:
                    if m[:2] == a[:2] and m[2] not in (None, a[2]) and a[3] < m[3] < b[3]:
                        n[a[2], a[0]] += 1
                        victims[a[2], a[0]].add(m[2])
    got = fraud.price_manipulation(df)
    assert {(r["trader"], r["block"]): (r["n"], r["victims"]) for r in got.collect()} == {k: (n[k], len(victims[k])) for k in n} != {}
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
