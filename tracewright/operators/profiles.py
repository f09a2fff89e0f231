"""Aggregates over transfers: profiles of addresses, bands of behaviour, concentrations of holdings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.functions.scalars import is_round_amount, just_below, ladder, micros, structuring_band
from tracewright.operators.quantiles import counted, quantiles

HOUR_US = 3_600_000_000


def _dealt(ends: DataFrame, n: int | None) -> DataFrame:
    """Ends of transfers in so many parts by address, if that is set: what a task groups then has a bound that its caller chooses."""
    return ends.repartition(n, "address") if n else ends


def flow_profile(t: DataFrame, n: int | None = None) -> DataFrame:
    """For each address: transfers and value out and in, net flow, distinct partners each way (0 where there are none).

    Both ends of a transfer come from one pass over t; sums by pair come first, so partners are counted without a distinct. n: parts by address.
    """
    side = lambda own, other, o: F.struct(F.col(own).alias("address"), F.col(other).alias("partner"), F.lit(o).alias("o"), F.lit(1 - o).alias("i"), F.col("value"))
    ends = t.select(F.explode(F.array(side("src", "dst", 1), side("dst", "src", 0))).alias("e")).select("e.*").filter("address IS NOT NULL")
    pairs = _dealt(ends, n).groupBy("address", "partner").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.sum(F.col("o") * F.col("value")).alias("vo"), F.sum(F.col("i") * F.col("value")).alias("vi"))
    there = F.col("partner").isNotNull()
    g = pairs.groupBy("address").agg(
        F.sum("o").cast("long").alias("n_out"), F.count_if(there & (F.col("o") > 0)).alias("partners_out"), F.sum("i").cast("long").alias("n_in"), F.count_if(there & (F.col("i") > 0)).alias("partners_in"),
        F.coalesce(F.sum("vo"), F.lit(0.0)).alias("vo"), F.coalesce(F.sum("vi"), F.lit(0.0)).alias("vi"),
    )
    return g.select("address", "n_out", "partners_out", "n_in", "partners_in", F.round("vo", 4).alias("out_value"), F.round("vi", 4).alias("in_value"), F.round(F.col("vi") - F.col("vo"), 4).alias("net_flow"))


def node_rollup(t: DataFrame) -> DataFrame:
    """Every address with value in and out, transfers, chains, first and last time, labels of a flow graph and a risk score."""
    sides = t.select(F.col("src").alias("address"), F.lit(0.0).alias("i"), F.col("value").alias("o"), "chain", "ts").unionByName(
        t.select(F.col("dst").alias("address"), F.col("value").alias("i"), F.lit(0.0).alias("o"), "chain", "ts")
    )
    r = sides.groupBy("address").agg(
        F.sum("i").alias("i"),
        F.sum("o").alias("o"),
        F.count("*").alias("n_tx"),
        F.sum((F.col("i") > 0).cast("long")).alias("n_in"),
        F.sum((F.col("o") > 0).cast("long")).alias("n_out"),
        F.array_join(F.array_sort(F.collect_set("chain")), ",").alias("chains"),
        F.countDistinct("chain").alias("n_chains"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )
    total, net = F.col("i") + F.col("o"), F.col("i") - F.col("o")
    balance = F.when(F.greatest("i", "o") > 0, F.least("i", "o") / F.greatest("i", "o")).otherwise(0.0)
    risk = (
        F.when(F.col("n_in") >= 5, F.least(F.lit(20), F.col("n_in"))).otherwise(0)
        + F.when(F.col("n_out") >= 5, F.least(F.lit(20), F.col("n_out"))).otherwise(0)
        + F.when(F.col("n_chains") > 1, 5 * F.col("n_chains")).otherwise(0)
        + ladder(total, [(1e6, 25), (1e5, 15), (1e4, 5)], 0)
        + ladder(balance, [(0.9, 20), (0.7, 10)], 0)
    )
    label = F.when((net > 0) & (net > 0.8 * F.col("i")), "ACCUMULATOR").when((net < 0) & (F.abs(net) > 0.8 * F.col("o")), "SOURCE").otherwise("NEUTRAL")
    return r.select("address", F.round("i", 4).alias("in_usd"), F.round("o", 4).alias("out_usd"), F.round(net, 4).alias("net_usd"), "n_tx", "chains", "first_seen", "last_seen", label.alias("label"), F.least(F.lit(100), risk).cast("long").alias("risk"))


def flow_metrics(t: DataFrame) -> DataFrame:
    """One row: value, transfers, addresses, chains, hours, rates and density of the whole graph."""
    ends = t.select(F.explode(F.array("src", "dst")).alias("a")).agg(F.countDistinct("a").alias("addresses"))
    m = t.agg(F.sum("value").alias("total"), F.avg("value").alias("mean"), F.max("value").alias("largest"), F.count("*").alias("n"), F.countDistinct("chain").alias("chains"), F.countDistinct("src", "dst").alias("edges"), ((F.max(micros(F.col("ts"))) - F.min(micros(F.col("ts")))) / HOUR_US).alias("hours"))
    return m.crossJoin(ends).select(  # one row each
        F.round("total", 4).alias("total_usd"), F.round("mean", 4).alias("mean_usd"), F.round("largest", 4).alias("max_usd"), "n", "addresses", "chains", F.round("hours", 4).alias("hours"),
        F.round(F.col("n") / F.nullif("hours", F.lit(0.0)), 6).alias("tx_per_hour"), F.round(F.col("total") / F.nullif("hours", F.lit(0.0)), 4).alias("usd_per_hour"),
        F.round(F.col("edges") / (F.col("addresses") * (F.col("addresses") - 1)), 8).alias("density"),
    )


def repeated_pairs(t: DataFrame, least: int, span_days: int) -> DataFrame:
    """Pairs with more than least transfers inside so many days: count, sum, mean, and a band of confidence (smurfing)."""
    g = t.groupBy("src", "dst").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    near = micros(F.col("last_ts")) - micros(F.col("first_ts")) < span_days * 24 * HOUR_US
    return g.filter((F.col("n") > least) & near).withColumn("confidence", ladder(F.col("n"), [(50, 0.9), (30, 0.7), (20, 0.5)], 0.3))


def senders_by_count(t: DataFrame, least: int, high: int, middle: int) -> DataFrame:
    """Senders of more than least transfers, with a band."""
    g = t.groupBy("src").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.filter(F.col("n") > least).withColumn("band", ladder(F.col("n"), [(high, "HIGH"), (middle, "MEDIUM")], "LOW"))


def structuring(t: DataFrame, least: int, key: str = "src") -> DataFrame:
    """Keys with at least so many transfers just under the threshold."""
    return t.filter(structuring_band(F.col("value"))).groupBy(key).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).filter(F.col("n") >= least)


def smurf_targets(t: DataFrame, sources: int, count: int) -> DataFrame:
    g = t.groupBy("dst").agg(F.countDistinct("src").alias("sources"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.filter((F.col("sources") >= sources) & (F.col("n") >= count))


def velocity(t: DataFrame, count: int, total: float) -> DataFrame:
    g = t.groupBy("src").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round((F.max(micros(F.col("ts"))) - F.min(micros(F.col("ts")))) / HOUR_US, 4).alias("span_hours"))
    return g.filter((F.col("n") > count) & (F.col("total") > total))


def hourly_peaks(t: DataFrame, peak: int, times: float, key: str = "src") -> DataFrame:
    """Keys whose busiest hour exceeds peak and times the mean of their active hours; the earliest of equal hours."""
    hours = t.groupBy(key, F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))
    top = F.max_by("hour", F.struct("n", -F.unix_seconds("hour")))
    g = hours.groupBy(key).agg(F.max("n").alias("peak"), F.round(F.avg("n"), 6).alias("mean"), top.alias("peak_hour"))
    return g.filter((F.col("peak") > peak) & (F.col("peak") > times * F.col("mean")))


def usual_hours(t: DataFrame, keep: int = 3, key: str = "src") -> DataFrame:
    """The busiest hours of the day of each key, the earlier of equals, as a list in order of the hour."""
    n = t.groupBy(key, F.hour("ts").alias("h")).agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "h"))
    return n.withColumn("r", r).filter(F.col("r") <= keep).groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("h")), ",").alias("hours"))


def outside_usual_hours(t: DataFrame, id_col: str, key: str = "src", keep: int = 3) -> DataFrame:
    """Transfers in hours that aren't among the key's usual ones (an anti join)."""
    n = t.groupBy(key, F.hour("ts").alias("h")).agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "h"))
    usual = n.withColumn("r", r).filter(F.col("r") <= keep).select(key, "h")
    return t.withColumn("h", F.hour("ts")).join(usual, [key, "h"], "left_anti").select(id_col, key, "h")


def bridge_usage(t: DataFrame, known: list[str]) -> DataFrame:
    """Use of bridges by chain: counts, sums, first and last time, banded risk; bridges that aren't known count as one."""
    b = t.withColumn("bridge", F.when(F.col("dst").isin(known), F.col("dst")).otherwise(F.lit("unknown")))
    g = b.groupBy("chain", "bridge").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.avg("value").alias("m"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    risk = F.when(F.col("bridge") == "unknown", 30).otherwise(0) + ladder(F.col("n"), [(10, 20), (5, 10)], 0) + ladder(F.col("m"), [(50_000, 20), (10_000, 10)], 0)
    return g.select("chain", "bridge", "n", F.round("s", 4).alias("total"), F.round("m", 4).alias("mean"), "first_ts", "last_ts", F.least(F.lit(100), risk).cast("long").alias("risk"))


def whale_tiers(t: DataFrame, tier1: float, tier2: float, large: float) -> DataFrame:
    """Wallets by value moved: TIER1, TIER2, ACTIVE (a large transfer); others are left out."""
    g = t.groupBy(F.col("src").alias("wallet")).agg(F.sum("value").alias("s"), F.sum((F.col("value") >= large).cast("long")).alias("n_large"), F.max("ts").alias("last_active"), F.countDistinct("chain").alias("chains"))
    tier = F.when(F.col("s") >= tier1, "TIER1").when(F.col("s") >= tier2, "TIER2").when(F.col("n_large") > 0, "ACTIVE")
    return g.select("wallet", F.round("s", 4).alias("total"), "n_large", "last_active", "chains", tier.alias("tier")).filter("tier is not null")


def movement_stats(t: DataFrame) -> DataFrame:
    """Counts, sums and means by kind and chain, with subtotals."""
    g = t.cube("tx_type", "chain").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 4).alias("mean"), F.grouping_id().cast("long").alias("level"))
    return g


def holder_concentration(b: DataFrame) -> DataFrame:
    """Of each token: holders, Gini index, shares of the top 1 % and 10 % of holders, and a ladder of risk.

    Ranks come from counts of equal amounts in parts by range, so a token with many holders isn't one task.
    """
    n, amount = F.col("n"), F.col("amount")
    above = F.col("total") - F.col("before") - n

    def top(share: float) -> Column:
        cut = F.greatest(F.lit(1), F.floor(F.col("total") * share))
        return F.sum(F.greatest(F.lit(0), F.least(n, cut - above)) * amount)

    g = counted(b, "token", "amount").groupBy("token").agg(F.max("total").alias("holders"), F.sum(n * amount).alias("s"), F.sum(amount * (n * F.col("before") + n * (n + 1) / 2)).alias("w"), top(0.01).alias("t1"), top(0.1).alias("t10"))
    gini = F.round(F.when(F.col("s") > 0, 2 * F.col("w") / (F.col("holders") * F.col("s")) - (F.col("holders") + 1) / F.col("holders")).otherwise(0.0), 4)
    out = g.select("token", "holders", gini.alias("gini"), F.round(100 * F.col("t1") / F.col("s"), 2).alias("top1_pct"), F.round(100 * F.col("t10") / F.col("s"), 2).alias("top10_pct"))
    risk = ladder(F.col("gini"), [(0.7, 5), (0.5, 3)], 0) + ladder(F.col("top1_pct"), [(50, 4), (20, 2)], 0) + ladder(F.col("top10_pct"), [(80, 3), (50, 1)], 0)
    return out.withColumn("risk", F.least(F.lit(10), risk).cast("long"))


def top_holders(b: DataFrame, keep: int = 5) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("amount"), "wallet"))
    return b.withColumn("rank", r).filter(F.col("rank") <= keep)


def related_addresses(t: DataFrame) -> DataFrame:
    """Of each address and partner: counts and values each way, first and last time."""
    a = t.select(F.col("src").alias("address"), F.col("dst").alias("partner"), F.lit(1).alias("o"), "value", "ts")
    b = t.select(F.col("dst").alias("address"), F.col("src").alias("partner"), F.lit(0).alias("o"), "value", "ts")
    return a.unionByName(b).groupBy("address", "partner").agg(
        F.sum("o").cast("long").alias("n_out"), F.sum(1 - F.col("o")).cast("long").alias("n_in"), F.round(F.sum("value"), 4).alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def dominance(t: DataFrame, key: str) -> DataFrame:
    """Share of each key in the total, in percent."""
    g = t.groupBy(key).agg(F.sum("value").alias("s"))
    total = g.agg(F.sum("s").alias("all"))
    return g.crossJoin(F.broadcast(total)).select(key, F.round("s", 4).alias("total"), F.round(100 * F.col("s") / F.col("all"), 4).alias("pct"))  # one row


def round_amounts(t: DataFrame, value: Column, least: float) -> DataFrame:
    return t.withColumn("amount", value).filter(is_round_amount(F.col("amount"), least))


def just_below_amounts(t: DataFrame) -> DataFrame:
    return t.filter(just_below(F.col("value"))).select("tx_id", "src", "dst", F.round("value", 4).alias("value"))


def net_positions(t: DataFrame, least: int) -> DataFrame:
    """Addresses that buy and sell alike: sums within 10 percent, more than least of each."""
    g = t.groupBy("token", "chain").agg(
        F.sum(F.when(F.col("tx_type") == "N", F.col("value"))).alias("b"), F.sum(F.when(F.col("tx_type") != "N", F.col("value"))).alias("s"),
        F.count(F.when(F.col("tx_type") == "N", 1)).alias("buys"), F.count(F.when(F.col("tx_type") != "N", 1)).alias("sells"),
    )
    even = F.abs(F.col("b") - F.col("s")) < 0.1 * F.greatest("b", "s")
    return g.filter((F.col("buys") > least) & (F.col("sells") > least) & even).select("token", "chain", F.round("b", 4).alias("bought"), F.round("s", 4).alias("sold"), "buys", "sells")


def of_tenant(t: DataFrame, column: str, tenant: object) -> DataFrame:
    """Rows of one tenant; rows without a tenant belong to none."""
    return t.filter(F.col(column).isNotNull() & (F.col(column) == F.lit(tenant)))


def recent_blocks(t: DataFrame, block: str, hours: int) -> DataFrame:
    """Rows of blocks (times) within so many hours of the newest."""
    number = F.floor(F.unix_micros(F.col(block).cast("timestamp")) / 3_600_000_000)
    last = t.agg(F.max(number).alias("_last"))
    return t.crossJoin(F.broadcast(last)).filter(number >= F.col("_last") - hours).drop("_last")  # one row


def token_counts(t: DataFrame, n: int | None = None) -> DataFrame:
    """Of each address: distinct tokens on either side, transfers out and in. n: parts by address."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("address"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("address"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")
    each = _dealt(t.select("token", ends).select("token", "e.*"), n)
    return each.groupBy("address").agg(F.countDistinct("token").alias("tokens"), F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, nulls, distinct_, low, high, mean, median, deviation): one row for each numeric column, in one pass over long rows."""
    long_ = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("e")).select("e.*")
    r = lambda c, n: F.round(c, 6).alias(n)
    g = long_.groupBy("name").agg(F.count_if(F.col("v").isNull()).alias("nulls"), F.countDistinct("v").alias("distinct_"), F.round(F.min("v"), 4).alias("low"), F.round(F.max("v"), 4).alias("high"), r(F.avg("v"), "mean"), r(F.stddev_samp("v"), "deviation"))
    return g.join(quantiles(long_, "name", "v", {"median": 0.5}).select("name", r("median", "median")), "name")


def top_values(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """(name, value, n): the n most frequent values of each column, ties to the smaller."""
    long_ = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("e")).select("e.*")
    counts = long_.groupBy("name", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "value"))).filter(F.col("_r") <= n).drop("_r")


def wallet_risk(t: DataFrame, low: Column, approval: Column, big: Column) -> DataFrame:
    """(wallet, score, level) from holdings of low liquidity, approvals, large sends and transfers a day."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    g = t.groupBy(F.col("src").alias("wallet")).agg(F.count("*").alias("n"), F.count_if(low).alias("low"), F.count_if(approval).alias("app"), F.count_if(big).alias("big"), ((F.max(us) - F.min(us)) / 1e6).alias("span"))
    pace = F.coalesce(F.try_divide(F.col("n"), F.col("span")) * 86400 > 20, F.lit(False)) & (F.col("n") >= 2)
    points = 2 * F.col("low") + F.when(F.col("low") > 0.5 * F.col("n"), 3).otherwise(0) + F.when(F.col("app") > 5, 2).otherwise(0) + F.col("big") + F.when(pace, 2).otherwise(0)
    return g.select("wallet", F.least(F.lit(100), 5 * points).cast("long").alias("score"), F.when(5 * points >= 75, "HIGH").when(5 * points >= 40, "MEDIUM").otherwise("LOW").alias("level"))


def token_risk(low: Column, pool: Column, least: float, name: Column, price: Column) -> Column:
    """3 for low liquidity, 2 for a small pool, 1 for a missing name, 1 for a price of next to nothing; at most 5."""
    return F.least(F.lit(5), F.when(low, 3).otherwise(0) + F.when(pool < least, 2).otherwise(0) + F.when(name.isNull() | (name == ""), 1).otherwise(0) + F.when(price < 1e-6, 1).otherwise(0)).cast("long")


def wallet_summary(t: DataFrame) -> DataFrame:
    """First and last transfer of each sender, its tokens, and how many tokens it moved last (ties to the larger tx_id)."""
    owner = t.groupBy("token").agg(F.max_by("src", F.struct("ts", "tx_id")).alias("wallet")).groupBy("wallet").agg(F.count("*").alias("owned"))
    g = t.groupBy(F.col("src").alias("wallet")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("token").alias("tokens"))
    return g.join(owner, "wallet", "left").fillna({"owned": 0})


def counts_by(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(kind, name, n): rows by each of several columns, in one pass."""
    long_ = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("name")) for k, c in kinds.items()])).alias("e")).select("e.*")
    return long_.groupBy("kind", "name").agg(F.count("*").alias("n"))


def alerts(t: DataFrame, least: float, high: float = 10.0) -> DataFrame:
    """Transfers of at least so much; HIGH from high times that on."""
    return t.filter(F.col("value") >= least).withColumn("level", F.when(F.col("value") >= high * least, "HIGH").otherwise("MEDIUM"))


def top_by_metric(nodes: DataFrame, key: str, metrics: list[str], n: int) -> DataFrame:
    """(metric, key, rank): the n best of each metric, ties to the smaller key."""
    found = None
    for m in metrics:
        best = nodes.orderBy(F.desc(m), key).limit(n)
        ranked = best.select(F.lit(m).alias("metric"), key, F.row_number().over(Window.orderBy(F.desc(m), key)).alias("rank"))  # n rows
        found = ranked if found is None else found.unionByName(ranked)
    return found


def shared_hours(t: DataFrame) -> DataFrame:
    """(a, b, jaccard): pairs that have a transfer between them, by the hours of the day in which each sends."""
    hours = t.groupBy("src").agg(F.collect_set(F.hour("ts")).alias("hours"))
    pairs = t.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    j = pairs.join(hours.select(F.col("src").alias("a"), F.col("hours").alias("x")), "a").join(hours.select(F.col("src").alias("b"), F.col("hours").alias("y")), "b")
    return j.select("a", "b", F.round(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")), 6).alias("jaccard"))


def first_bundle(bundles: list[DataFrame], key: str) -> DataFrame:
    """The rows of several bundles, of each key that of the first bundle that has it."""
    found = None
    for place, b in enumerate(bundles):
        b = b.withColumn("_place", F.lit(place))
        found = b if found is None else found.unionByName(b)
    rest = [c for c in bundles[0].columns if c != key]
    return found.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("_place", *rest)).alias("_row")).select(key, "_row.*")


def whale_candidates(t: DataFrame, least: float, known: list[str]) -> DataFrame:
    """(wallet): known ones and both ends of large transfers."""
    ends = t.filter(F.col("value") >= least).select(F.explode(F.array("src", "dst")).alias("wallet"))
    return ends.union(t.sparkSession.createDataFrame([(k,) for k in known], "wallet string")).distinct()
