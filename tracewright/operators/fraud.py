"""Joins of trades, transfers and accounts that point to fraud: loans within a block, mixers, round trips, insiders, abandoned tokens."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracewright.functions.scalars import ladder, micros
from tracewright.operators.interval import forward_join, renamed
from tracewright.operators.ordering import greedy_windows


def reciprocal_pairs(pairs: DataFrame, least: int, most: int) -> DataFrame:
    """Pairs of addresses by reciprocal transfers (src1, dst1, value1, value2): at least so many, a band of risk, the largest most."""
    a, b = F.least("src1", "dst1"), F.greatest("src1", "dst1")
    g = pairs.groupBy(a.alias("a"), b.alias("b")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("value1") + F.col("value2")), 2).alias("total")).filter(F.col("n") >= least)
    return g.withColumn("risk", ladder(F.col("n"), [(20, "HIGH"), (10, "MEDIUM")], "LOW")).orderBy(F.desc("n"), "a", "b").limit(most)


def between_trades(t: DataFrame) -> DataFrame:
    """(trader, block, dex, first, middle, last): three trades of one trader in a block on an exchange, by place, where first and last swap the same two tokens back.

    t has block, dex, trader, place, bought and sold. First trades meet only later trades with their tokens swapped, by
    equality on all five columns, so a busy block isn't squared.
    """
    one = renamed(t.select("block", "dex", "trader", "place", "bought", "sold").filter("bought <> sold"), "1")
    three = renamed(t.select("block", "dex", "trader", "place", "bought", "sold"), "3")
    same = (F.col("block1") == F.col("block3")) & (F.col("dex1") == F.col("dex3")) & (F.col("trader1") == F.col("trader3"))
    back = one.join(three, same & (F.col("bought1") == F.col("sold3")) & (F.col("sold1") == F.col("bought3")) & (F.col("place1") < F.col("place3")))
    middle = renamed(t.select("block", "dex", "trader", "place"), "2")
    found = back.join(middle, (F.col("block1") == F.col("block2")) & (F.col("dex1") == F.col("dex2")) & (F.col("place1") < F.col("place2")) & (F.col("place2") < F.col("place3")))
    return found.select(F.col("trader1").alias("trader"), F.col("block1").alias("block"), F.col("dex1").alias("dex"), F.col("place1").alias("first"), F.col("trader2").alias("middle_trader"), F.col("place2").alias("middle"), F.col("place3").alias("last"))


def price_manipulation(t: DataFrame) -> DataFrame:
    """(trader, block, n, victims): trades of others between two trades of a trader that swap the same two tokens back, and distinct others.

    t has block, dex, trader, place (a whole number), bought and sold. The rows are those of between_trades() with another trader in the
    middle, counted and not made: n comes from running counts, as others before the last trade less others up to the first. All spans
    of a trader, an exchange and two tokens lie in two at most, from the first trade one way to the last trade back; distinct traders are
    marked along these by block.
    """
    t = t.select("block", "dex", "trader", "place", "bought", "sold").dropna(subset=["block", "dex", "trader", "place"])
    every, own = (Window.partitionBy("block", "dex", *more).orderBy("place") for more in ((), ("trader",)))
    upto = lambda w: F.count("*").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    placed = t.withColumns({"_lt": F.rank().over(every) - 1, "_le": upto(every)}).withColumns({"_own_lt": F.rank().over(own) - 1, "_own_le": upto(own)})
    swaps = placed.filter("bought <> sold").select(
        "block", "dex", "trader", "place", F.least("bought", "sold").alias("_x"), F.greatest("bought", "sold").alias("_y"), (F.col("bought") < F.col("sold")).alias("_up"),
        "_lt", "_le", (F.col("_lt") - F.col("_own_lt")).alias("_before"), (F.col("_le") - F.col("_own_le")).alias("_upto"),
    )
    pair = ["block", "dex", "trader", "_x", "_y"]
    earlier = Window.partitionBy(*pair).orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    back = lambda up: F.count_if(F.col("_up") != F.lit(up)).over(earlier) * F.col("_before") - F.coalesce(F.sum(F.when(F.col("_up") != F.lit(up), F.col("_upto"))).over(earlier), F.lit(0))
    counted = swaps.withColumn("_n", F.when(F.col("_up"), back(True)).otherwise(back(False)))
    # Spans are ranges of positions in the order of places: from the number of trades up to the first to the number before the last.
    lo, hi = (lambda up: F.min(F.when(F.col("_up") == F.lit(up), F.col("_le")))), (lambda up: F.max(F.when(F.col("_up") == F.lit(up), F.col("_lt"))))
    ends = counted.groupBy(*pair).agg(F.sum("_n").alias("n"), F.array(F.struct(lo(True).alias("lo"), hi(False).alias("hi")), F.struct(lo(False).alias("lo"), hi(True).alias("hi"))).alias("s"))
    found = ends.groupBy("block", "trader").agg(F.sum("n").alias("n"), F.flatten(F.collect_list(F.transform("s", lambda x: F.struct(F.col("dex").alias("dex"), x["lo"].alias("lo"), x["hi"].alias("hi"))))).alias("s")).filter("n > 0")
    spans = found.select("block", "trader", "n", F.inline("s")).filter("lo < hi")
    schema = StructType([t.schema["trader"], t.schema["block"], StructField("n", LongType()), StructField("victims", LongType())])
    return placed.select("block", "dex", "trader", F.col("_lt").alias("at")).groupBy("block").cogroup(spans.groupBy("block")).applyInPandas(_victims, schema)


def _victims(trades: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
    """Of a block: distinct traders but the own one in the spans [lo, hi) of each trader, by positions within exchanges."""
    trades = trades.sort_values(["dex", "at"])
    codes, names = pd.factorize(trades["trader"])
    own = pd.Series(np.arange(len(names)), index=names)
    first = {dex: int(np.searchsorted(trades["dex"].to_numpy(), dex)) for dex in spans["dex"].unique()}
    seen, out = np.zeros(len(names), bool), []
    for trader, s in spans.groupby("trader", sort=False):
        seen[:] = False
        for dex, lo, hi in zip(s["dex"], s["lo"], s["hi"], strict=True):
            seen[codes[first[dex] + lo : first[dex] + hi]] = True
        seen[own[trader]] = False
        out.append((trader, s["block"].iloc[0], s["n"].iloc[0], int(seen.sum())))
    return pd.DataFrame(out, columns=["trader", "block", "n", "victims"])


def hops(t: DataFrame, n: int, seconds: int, id_col: str) -> DataFrame:
    """Chains of n transfers where each starts at the last one's end, later, all within so many seconds of the first.

    Columns id1..n, src1..n, dst1..n, value1..n, ts1..n. The bins of the span keep each join an equality.
    """
    base = t.select(id_col, "src", "dst", "value", "ts")
    found = renamed(base, "1")
    for k in range(2, n + 1):
        found = forward_join(found, renamed(base, str(k)), [(f"dst{k - 1}", f"src{k}")], f"ts{k - 1}", f"ts{k}", seconds)
        found = found.filter((F.col(f"ts{k}") > F.col(f"ts{k - 1}")) & (micros(F.col(f"ts{k}")) - micros(F.col("ts1")) <= seconds * 1_000_000))
    return found


def insiders(holdings: DataFrame, sales: DataFrame, prices: DataFrame, share: float) -> DataFrame:
    """Early holders that sold near a token's highest price.

    holdings: (token, wallet, first_ts); sales: (token, wallet, ts, price, amount); prices: (token, price). A sale counts if it
    comes after the holder's first time and reaches a share of the highest price.
    """
    peak = prices.groupBy("token").agg(F.max("price").alias("peak"))
    late = sales.join(holdings, ["token", "wallet"]).filter("ts > first_ts").join(peak, "token").filter(F.col("price") >= share * F.col("peak"))
    return late.groupBy("token", "wallet").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 4).alias("sold"), F.round(F.max(F.col("price") / F.col("peak")), 6).alias("of_peak"))


def abandoned(t: DataFrame, key: str, first_days: int, last_days: int, share: float) -> DataFrame:
    """Keys whose rows in the last days are under a share of those in their first days; last_days count back from the newest row of all."""
    day = 86_400_000_000
    start = t.groupBy(key).agg(F.min(micros(F.col("ts"))).alias("_start"))
    end = t.agg(F.max(micros(F.col("ts"))).alias("_end"))
    at = micros(F.col("ts"))
    g = t.join(start, key).crossJoin(F.broadcast(end)).groupBy(key).agg(F.count_if(at <= F.col("_start") + first_days * day).alias("early"), F.count_if(at >= F.col("_end") - last_days * day).alias("late"))  # one row
    return g.filter(F.col("late") < share * F.col("early"))


def team_sales(sales: DataFrame, supply: DataFrame, share: float) -> DataFrame:
    """Tokens of which a team sold over a share of the supply; sales (token, wallet, amount), supply (token, supply)."""
    g = sales.groupBy("token").agg(F.sum("amount").alias("sold"), F.countDistinct("wallet").alias("sellers")).join(supply, "token")
    return g.filter(F.col("sold") > share * F.col("supply")).select("token", "sellers", F.round(F.col("sold") / F.col("supply"), 6).alias("share"))


def failed_sells(t: DataFrame, buyers: int, sellers: int) -> DataFrame:
    """Tokens with many buyers whose sales fail: t has bought, sold, trader, failed."""
    b = t.filter("not failed").groupBy(F.col("bought").alias("token")).agg(F.countDistinct("trader").alias("buyers"))
    s = t.filter("failed").groupBy(F.col("sold").alias("token")).agg(F.countDistinct("trader").alias("failed_sellers"))
    return b.join(s, "token").filter((F.col("buyers") >= buyers) & (F.col("failed_sellers") >= sellers))


def coordinated_buys(t: DataFrame, least: int, most: int) -> DataFrame:
    """Hours in which at least so many traders buy one token, the most buyers first; in_row: consecutive such hours so far."""
    g = t.groupBy(F.col("bought").alias("token"), "block").agg(F.countDistinct("trader").alias("buyers"), F.round(F.sum("amount"), 4).alias("amount")).filter(F.col("buyers") >= least)
    return g.orderBy(F.desc("buyers"), "token", "block").limit(most)


def dust_campaigns(t: DataFrame, dust: float, least: int, alike: int) -> DataFrame:
    """Senders of many dust transfers of which many have one size (to two decimals)."""
    small = t.filter(F.col("value") < dust).groupBy("src", F.round("value", 0).alias("size")).agg(F.count("*").alias("n"))
    return small.groupBy("src").agg(F.sum("n").alias("n"), F.max("n").alias("alike")).filter((F.col("n") >= least) & (F.col("alike") >= alike))


def pump_days(s: DataFrame) -> DataFrame:
    """Of each token's daily prices: peak, its day, lowest before, lowest after, and both changes in percent (null without a price on that side)."""
    top = s.groupBy("token").agg(F.max(F.struct("price", F.negate(F.datediff("day", F.lit("1970-01-01"))).alias("d"))).alias("x")).select(F.col("token").alias("_t"), F.col("x.price").alias("peak"), F.date_add(F.lit("1970-01-01").cast("date"), F.negate(F.col("x.d"))).alias("peak_day"))
    j = s.join(top, F.col("token") == F.col("_t"))
    g = j.groupBy("token", "peak", "peak_day").agg(F.min(F.when(F.col("day") < F.col("peak_day"), F.col("price"))).alias("before"), F.min(F.when(F.col("day") > F.col("peak_day"), F.col("price"))).alias("after"))
    return g.select("token", "peak_day", F.round("peak", 6).alias("peak"), F.round(100 * (F.col("peak") / F.col("before") - 1), 4).alias("pump_pct"), F.round(100 * (1 - F.col("after") / F.col("peak")), 4).alias("dump_pct"))


def hourly_last(t: DataFrame, key: str, ts: str, id_col: str, price: str, volume: str) -> DataFrame:
    """One row for each hour with any: last price (by time, then id) and sum of volume."""
    g = t.groupBy(key, F.date_trunc("hour", F.col(ts).cast("timestamp")).alias("hour"))
    return g.agg(F.max_by(price, F.struct(ts, id_col)).alias("price"), F.round(F.sum(volume), 4).alias("volume"))


def whale_windows(m: DataFrame, seconds: int, least: int) -> DataFrame:
    """(anchor, n, parties): movements (id, party, ts) in greedy windows: each opens with the first movement that no earlier window holds.

    n counts the window's movements, itself included, and parties those who make them; windows of fewer than `least` movements go.
    """
    windows = greedy_windows(m.select("id", "party", "ts"), "id", "ts", seconds)
    return windows.groupBy("anchor").agg(F.count("*").alias("n"), F.countDistinct("party").alias("parties")).filter(F.col("n") >= least)


def coordination(t: DataFrame, seconds: int, rows: int, parties: int) -> DataFrame:
    """(kind, party, bucket, n, others, confidence): senders to, or receivers from, several parties within one bucket of time."""
    bucket = F.floor(micros(F.col("ts")) / (seconds * 1_000_000)).alias("bucket")
    sides = F.explode(F.array(F.struct(F.lit("DISTRIBUTION").alias("kind"), F.col("src").alias("party"), F.col("dst").alias("other")), F.struct(F.lit("ACCUMULATION").alias("kind"), F.col("dst").alias("party"), F.col("src").alias("other")))).alias("e")
    g = t.select(bucket, sides).groupBy("e.kind", "e.party", "bucket").agg(F.count("*").alias("n"), F.countDistinct("e.other").alias("others")).filter((F.col("n") >= rows) & (F.col("others") >= parties))
    return g.withColumn("confidence", F.when(F.col("n") >= 5, 0.8).otherwise(0.6))


def parallel_chains(t: DataFrame, key: str, ts: str, chain: str, seconds: int, least: int = 2) -> DataFrame:
    """(key, bucket, chains): buckets of time in which a key is active on several chains."""
    bucket = F.floor(micros(F.col(ts)) / (seconds * 1_000_000)).alias("bucket")
    return t.groupBy(key, bucket).agg(F.countDistinct(chain).alias("chains")).filter(F.col("chains") >= least)


def newest_per_key(t: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The n newest rows of each key (Spark drops the rest of a group before the shuffle, too)."""
    return t.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")
