"""Joins of transfers with transfers: reciprocal pairs, pass-through, cross-chain hops, rings, reversals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.functions.scalars import ladder, micros
from tracewright.lineage import written
from tracewright.operators.graph import ordinals
from tracewright.operators.interval import forward_join, renamed


def gap_seconds(later: str, earlier: str) -> Column:
    return (micros(F.col(later)) - micros(F.col(earlier))) / 1e6


def reciprocal(t: DataFrame, seconds: int, id_col: str, closeness: float | None = None) -> DataFrame:
    """Pairs a -> b and b -> a within so many seconds of each other, each once; closeness bounds the relative difference in value."""
    a, b = renamed(t.select(id_col, "src", "dst", "value", "ts"), "1"), renamed(t.select(id_col, "src", "dst", "value", "ts"), "2")
    found = forward_join(a, b, [("src1", "dst2"), ("dst1", "src2")], "ts1", "ts2", seconds)
    ordered = (F.col("ts1") < F.col("ts2")) | (F.col(f"{id_col}1") < F.col(f"{id_col}2"))
    found = found.filter(ordered & (F.col("src1") != F.col("dst1")))
    if closeness is not None:
        found = found.filter(F.abs(F.col("value1") - F.col("value2")) < closeness * F.col("value1"))
    return found


def wash_addresses(t: DataFrame, seconds: int, id_col: str) -> DataFrame:
    """Of each address that starts reciprocal pairs: their number, value, first partners and a band of confidence."""
    g = reciprocal(t, seconds, id_col).groupBy("src1").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("value1") + F.col("value2")), 2).alias("total"), F.array_join(F.transform(F.slice(F.array_sort(F.collect_set("dst1")), 1, 5), lambda x: x.cast("string")), ",").alias("partners")
    )
    return g.select(F.col("src1").alias("address"), "n", "total", "partners", ladder(F.col("n"), [(20, 0.9), (10, 0.7), (5, 0.5)], 0.3).alias("confidence"), (F.col("n") > 5).alias("suspicious"))


def pass_through(t: DataFrame, seconds: int, id_col: str, closeness: float = 0.1) -> DataFrame:
    """in -> a -> out within so many seconds with nearly the same value (layering); a band of confidence by both."""
    a, b = renamed(t.select(id_col, "src", "dst", "value", "ts"), "1"), renamed(t.select(id_col, "src", "dst", "value", "ts"), "2")
    found = forward_join(a, b, [("dst1", "src2")], "ts1", "ts2", seconds).filter(F.col(f"{id_col}1") != F.col(f"{id_col}2"))
    off = F.abs(F.col("value1") - F.col("value2")) / F.nullif("value1", F.lit(0.0))
    found = found.withColumn("off", off).withColumn("gap", gap_seconds("ts2", "ts1")).filter((F.col("off") < closeness) & (F.col("src1") != F.col("dst2")))
    confidence = F.when((F.col("off") < 0.01) & (F.col("gap") < 60), 0.9).when((F.col("off") < 0.05) & (F.col("gap") < 600), 0.7).when((F.col("off") < 0.1) & (F.col("gap") < 3600), 0.5).otherwise(0.3)
    return found.withColumn("confidence", confidence)


def cross_chain(t: DataFrame, seconds: int, least: float, known: list, id_col: str) -> DataFrame:
    """Outgoing on one chain, later incoming of the same wallet on another; scored by bridge, ratio of values and delay."""
    a, b = renamed(t.filter(F.col("value") >= least).select(id_col, "src", "dst", "value", "ts", "chain"), "1"), renamed(t.filter(F.col("value") >= least).select(id_col, "src", "dst", "value", "ts", "chain"), "2")
    found = forward_join(a, b, [("src1", "dst2")], "ts1", "ts2", seconds).filter((F.col("chain1") != F.col("chain2")) & (F.col(f"{id_col}1") != F.col(f"{id_col}2")))
    ratio, gap, bridge = F.least("value1", "value2") / F.greatest("value1", "value2"), gap_seconds("ts2", "ts1"), F.col("dst1").isin(known)
    confidence = F.least(F.lit(1.0), 0.5 + F.when(bridge, 0.3).otherwise(0.0) + ladder(ratio, [(0.9, 0.2), (0.7, 0.1)], 0.0) + F.when(gap < 300, 0.1).otherwise(0.0))
    risk = F.least(F.lit(100), ladder(F.col("value1"), [(100_000, 30), (10_000, 10)], 0) + F.when(bridge, 0).otherwise(20) + F.when(gap < 120, 10).otherwise(0))
    return found.select(F.col(f"{id_col}1").alias("out_id"), F.col(f"{id_col}2").alias("in_id"), F.col("src1").alias("wallet"), F.col("chain1").alias("from_chain"), F.col("chain2").alias("to_chain"), F.round(ratio, 6).alias("ratio"), F.round(confidence, 2).alias("confidence"), risk.cast("long").alias("risk"))


def rings(e: DataFrame, least: float) -> DataFrame:
    """a -> b -> c -> a over edges of more than so much value, each later than the one before, so a ring comes once, from its first edge."""
    big = e.filter((F.col("value") > least) & (F.col("src") != F.col("dst"))).select("src", "dst", "value", "ts")
    x, y, z = (renamed(big, str(k)) for k in (1, 2, 3))
    found = x.join(y, (F.col("dst1") == F.col("src2")) & (F.col("ts1") < F.col("ts2"))).join(z, (F.col("dst2") == F.col("src3")) & (F.col("dst3") == F.col("src1")) & (F.col("ts2") < F.col("ts3")))
    return found.select(F.col("src1").alias("a"), F.col("src2").alias("b"), F.col("src3").alias("c"), F.round(F.col("value1") + F.col("value2") + F.col("value3"), 2).alias("total"))


def sandwiches(t: DataFrame) -> DataFrame:
    """In one block and pool: a trade before and one after another's, by one trader, in opposite directions; counted by trader.

    t has block, pool, place (unique), trader and side (buy or sell); rows with a null in one of them are no trades. With C(x) others' trades of a side before x, a trader's pair (a, b)
    holds C(b) - C(a) of them; summed over the pairs of each b this needs running sums alone, so a busy pool is sorted and not joined with
    itself. Victims of a trader and side are those who trade on it between its first such trade and its last on the other.
    """
    pool = Window.partitionBy("block", "pool").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("block", "pool", "trader").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    is_side = {s: (F.col("side") == s).cast("long") for s in ("buy", "sell")}
    rows = t.select("block", "pool", "place", "trader", "side").dropna().filter(F.col("side").isin("buy", "sell"))
    rows = rows.withColumns({f"_c_{s}": F.coalesce(F.sum(x).over(pool), F.lit(0)) for s, x in is_side.items()})
    rows = rows.withColumns({f"_c_{s}": F.col(f"_c_{s}") - F.coalesce(F.sum(x).over(own), F.lit(0)) for s, x in is_side.items()})
    before = lambda s: (F.coalesce(F.sum(is_side[s]).over(own), F.lit(0)), F.coalesce(F.sum(is_side[s] * F.col(f"_c_{s}")).over(own), F.lit(0)))
    held = [F.when(F.col("side") != s, before(s)[0] * F.col(f"_c_{s}") - before(s)[1]).otherwise(0) for s in ("buy", "sell")]
    counts = rows.withColumn("_held", held[0] + held[1]).groupBy("trader").agg(F.sum("_held").alias("n")).filter("n > 0")
    spans = rows.groupBy("block", "pool", F.col("trader").alias("_by")).agg(*[f(F.when(F.col("side") == s, F.col("place"))).alias(f"{n}_{s}") for s in ("buy", "sell") for n, f in (("first", F.min), ("last", F.max))])
    sides = spans.select("block", "pool", "_by", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"first_{s}").alias("a"), F.col(f"last_{o}").alias("b")) for s, o in (("buy", "sell"), ("sell", "buy"))])).alias("s"))
    sides = sides.select("block", "pool", "_by", "s.*").filter("a < b")
    hit = sides.join(rows.select("block", "pool", "side", "place", "trader"), ["block", "pool", "side"]).filter((F.col("place") > F.col("a")) & (F.col("place") < F.col("b")) & (F.col("trader") != F.col("_by")))
    victims = hit.groupBy("_by").agg(F.countDistinct("trader").alias("victims"))
    return counts.join(victims, F.col("trader") == F.col("_by")).select("trader", "n", "victims")


def reversed_structuring(deposits: DataFrame, withdrawals: DataFrame, small: float, large: float, least: int) -> DataFrame:
    """Accounts with at least so many small deposits before a large withdrawal. Both sides have account, value, ts."""
    d = deposits.filter(F.col("value") < small).select("account", F.col("value").alias("in_value"), F.col("ts").alias("in_ts"))
    w = withdrawals.filter(F.col("value") >= large).groupBy("account").agg(F.max("ts").alias("out_ts"), F.round(F.max("value"), 2).alias("largest"))
    return d.join(w, "account").filter("in_ts < out_ts").groupBy("account", "largest").agg(F.count("*").alias("n"), F.round(F.sum("in_value"), 2).alias("total")).filter(F.col("n") >= least)


def buyers_without_sellers(t: DataFrame, buyers: int) -> DataFrame:
    """Tokens that many buy and few sell (a left join, sellers 0 where there are none)."""
    b = t.filter("tx_type = 'N'").groupBy("token").agg(F.countDistinct("src").alias("buyers"))
    s = t.filter("tx_type = 'R'").groupBy("token").agg(F.countDistinct("src").alias("sellers"))
    return b.join(s, "token", "left").select("token", "buyers", F.coalesce("sellers", F.lit(0)).cast("long").alias("sellers")).filter((F.col("buyers") >= buyers) & (F.col("sellers") * 2 < F.col("buyers")))


def dust_then_reply(t: DataFrame, dust: float, days: int, id_col: str) -> DataFrame:
    """Senders of dust: how many got it, and how many of those sent anything within so many days after."""
    d = renamed(t.filter(F.col("value") < dust).select(id_col, "src", "dst", "ts"), "1")
    r = renamed(t.select(id_col, "src", "ts"), "2")
    hit = forward_join(d, r, [("dst1", "src2")], "ts1", "ts2", days * 86_400).filter("ts2 > ts1").select(f"{id_col}1").distinct().withColumn("replied", F.lit(1))
    return d.join(hit, f"{id_col}1", "left").groupBy(F.col("src1").alias("sender")).agg(F.countDistinct("dst1").alias("targets"), F.coalesce(F.sum("replied"), F.lit(0)).cast("long").alias("replies"))


def overlapping_holders(b: DataFrame, least: int, hot: int = 1000) -> DataFrame:
    """Pairs of wallets that share at least so many tokens: common, overlap over the larger set, Jaccard.

    Tokens of at most `hot` wallets are joined with themselves and counted by pair, each pair one number, so that rows grow with the
    holdings. Hotter tokens are counted for those pairs alone, and for pairs that share
    hot ones only: two wallets that share `least` of them share one even without the least - 1 commonest of each.
    """
    one = written(b.select("wallet", "token").distinct().filter("wallet IS NOT NULL AND token IS NOT NULL"))
    ids = written(ordinals(one, "wallet").join(one.groupBy("wallet").agg(F.count("*").alias("n")), "wallet").filter(F.col("n") >= least).withColumnRenamed("ordinal", "_i"))
    common = one.groupBy("token").agg(F.count("*").alias("_f"))
    held = written(one.join(ids.select("wallet", "_i"), "wallet").join(common, "token").select("token", "_i", "_f"))
    pair = (F.shiftleft("_i", 32) + F.col("_j")).alias("_pair")
    other = lambda df: df.select(F.col("token").alias("_t"), F.col("_i").alias("_j"))
    meet = lambda df: df.join(other(df), (F.col("token") == F.col("_t")) & (F.col("_i") < F.col("_j")))
    counts = meet(held.filter(F.col("_f") <= hot).select("token", "_i")).select(pair).groupBy("_pair").agg(F.count("*").alias("common"))
    heavy = held.filter(F.col("_f") > hot)
    if not heavy.isEmpty():
        rank = F.row_number().over(Window.partitionBy("_i").orderBy(F.desc("_f"), F.desc("token")))
        rare = written(heavy.withColumn("_r", rank).filter(F.col("_r") >= least).select("token", "_i"))
        counts = written(counts)
        ends = [F.shiftright("_pair", 32).alias("_i"), F.col("_pair").bitwiseAND(0xFFFFFFFF).alias("_j")]
        pairs = written(counts.select("_pair").unionByName(meet(rare).select(pair)).distinct().select("_pair", *ends))
        h = heavy.select("token", "_i")
        more = pairs.join(h, "_i").join(h.withColumnRenamed("_i", "_j"), ["_j", "token"]).groupBy("_pair").agg(F.count("*").alias("common"))
        counts = counts.unionByName(more).groupBy("_pair").agg(F.sum("common").alias("common"))
    c = counts.filter(F.col("common") >= least).select("common", F.shiftright("_pair", 32).alias("_i1"), F.col("_pair").bitwiseAND(0xFFFFFFFF).alias("_i2"))
    c = c.join(renamed(ids.select("_i", "wallet", "n"), "1"), "_i1").join(renamed(ids.select("_i", "wallet", "n"), "2"), "_i2")
    return c.select("wallet1", "wallet2", "common", F.round(F.col("common") / F.greatest("n1", "n2"), 6).alias("overlap"), F.round(F.col("common") / (F.col("n1") + F.col("n2") - F.col("common")), 6).alias("jaccard"))


def latest(t: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return t.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")
