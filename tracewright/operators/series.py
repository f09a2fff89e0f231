"""Window functions over ordered rows: moving statistics, pumps and dumps, sessions, outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tracewright.functions.scalars import micros, severity
from tracewright.operators.quantiles import quantiles


def moving_deviation(s: DataFrame, key: str, order: list[str], value: str, size: int, k: float) -> DataFrame:
    """Rows that lie over k population deviations off the mean of the size rows before them (which must be there)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-size, -1)
    m, d, n = F.avg(value).over(w), F.stddev_pop(value).over(w), F.count(value).over(w)
    z = (F.col(value) - F.col("_m")) / F.col("_d")
    r = s.withColumn("_m", m).withColumn("_d", d).withColumn("_n", n).filter((F.col("_n") == size) & (F.col("_d") > 1e-9))
    return r.filter(F.abs(z) > k).select(key, *order, F.round(z, 4).alias("z"))


def changes(s: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Percent change from the row before; null for the first."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return s.select(key, order, F.round(100 * (F.col(value) - before) / F.nullif(before, F.lit(0.0)), 4).alias("change_pct"))


def pumps(s: DataFrame, lookback: int, price_pct: float, volume_pct: float, dump_pct: float, ahead: int = 48) -> DataFrame:
    """Rows of (token, day, price, volume) whose price and volume rise over the mean of the last lookback rows (this one included), and the first drop after."""
    order = Window.partitionBy("token").orderBy("day")
    w = order.rowsBetween(-(lookback - 1), 0)
    base = s.withColumn("n", F.count("*").over(w)).withColumn("pm", F.avg("price").over(w)).withColumn("vm", F.avg("volume").over(w))
    p, v = 100 * (F.col("price") / F.col("pm") - 1), 100 * (F.col("volume") / F.col("vm") - 1)
    nxt = F.collect_list(F.struct("day", "price")).over(order.rowsBetween(1, ahead))
    base = base.withColumn("nxt", nxt).filter((F.col("n") == lookback) & (p > price_pct) & (v > volume_pct))
    drop = F.filter("nxt", lambda x: (F.col("price") - x["price"]) / F.col("price") * 100 > dump_pct)
    return base.select("token", "day", F.round(p, 4).alias("price_pct"), F.round(v, 4).alias("volume_pct"), F.get(drop, F.lit(0))["day"].alias("dump_day"), F.round((p + v) / 2, 4).alias("score"))


def sessions(e: DataFrame, key: str, ts: str, id_col: str, gap_seconds: int) -> DataFrame:
    """Runs of a key's events with less than the gap between neighbours: start, end, number."""
    w = Window.partitionBy(key).orderBy(ts, id_col)
    new = F.coalesce((micros(F.col(ts)) - F.lag(micros(F.col(ts))).over(w) >= gap_seconds * 1_000_000).cast("int"), F.lit(1))
    marked = e.withColumn("_new", new).withColumn("_s", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "_s").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n")).drop("_s")


def chain_hopping(e: DataFrame, key: str, ts: str, id_col: str, chain: str, chains: int, least: int) -> DataFrame:
    """Keys that change between chains: distinct chains and changes."""
    before = F.lag(chain).over(Window.partitionBy(key).orderBy(ts, id_col))
    g = e.withColumn("_b", before).groupBy(key).agg(F.countDistinct(chain).alias("chains"), F.sum((F.col("_b") != F.col(chain)).cast("long")).alias("changes"))
    return g.select(key, "chains", F.coalesce("changes", F.lit(0)).cast("long").alias("changes")).filter((F.col("chains") >= chains) & (F.col("changes") >= least))


def withdrawals_of_pool(s: DataFrame, share: float) -> DataFrame:
    """Days whose volume exceeds a share of all volume before."""
    before = F.sum("volume").over(Window.partitionBy("token").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    return s.withColumn("prior", before).filter(F.col("volume") > share * F.col("prior")).select("token", "day", "volume", F.round("prior", 2).alias("prior"))


def zscores(t: DataFrame, key: str, id_col: str, value: str, k: float, least: int) -> DataFrame:
    """Rows over k population deviations from their key's mean, with severity and confidence; keys of fewer rows give none."""
    g = t.groupBy(key).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("d"), F.count(value).alias("n")).filter((F.col("n") >= least) & (F.col("d") > 0))
    z = F.abs(F.col(value) - F.col("m")) / F.col("d")
    r = t.join(g, key).withColumn("z", z).filter(F.col("z") > k)
    return r.select(id_col, key, F.round("z", 4).alias("z"), severity(F.col("z"), k).alias("severity"), F.round(F.least(F.lit(0.95), 0.5 + F.col("z") / (4 * k) * 0.5), 4).alias("confidence"))


def iqr_outliers(t: DataFrame, key: str, id_col: str, value: str, c: float = 1.5) -> DataFrame:
    """Rows beyond c interquartile ranges (interpolated), with their distance in ranges."""
    g = quantiles(t, key, value, {"q1": 0.25, "q3": 0.75})
    r = t.join(g, key).withColumn("iqr", F.col("q3") - F.col("q1")).filter("iqr > 0")
    off = F.when(F.col(value) > F.col("q3"), F.col(value) - F.col("q3")).otherwise(F.col("q1") - F.col(value)) / F.col("iqr")
    return r.withColumn("off", off).filter(F.col("off") > c).select(id_col, key, F.round("off", 4).alias("score"))


def threshold_outliers(t: DataFrame, key: str, id_col: str, value: str, k: float = 3.0) -> DataFrame:
    """Rows beyond k sample deviations of their key."""
    g = t.groupBy(key).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("d"))
    return t.join(g, key).filter(F.abs(F.col(value) - F.col("m")) > k * F.col("d")).select(id_col, key)


def quantile_outliers(t: DataFrame, key: str, id_col: str, value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Rows outside two quantiles of their key (interpolated)."""
    g = quantiles(t, key, value, {"lo": low, "hi": high})
    return t.join(g, key).filter((F.col(value) < F.col("lo")) | (F.col(value) > F.col("hi"))).select(id_col, key)


def growth(s: DataFrame) -> DataFrame:
    """Of each token: first and last price, change, and the population deviation of daily changes."""
    w = Window.partitionBy("token").orderBy("day")
    pct = 100 * (F.col("price") / F.lag("price").over(w) - 1)
    g = s.withColumn("pct", pct).groupBy("token").agg(F.min_by("price", "day").alias("first"), F.max_by("price", "day").alias("last"), F.stddev_pop("pct").alias("vol"))
    return g.select("token", F.round("first", 6).alias("first"), F.round("last", 6).alias("last"), F.round(F.col("last") - F.col("first"), 6).alias("change"), F.round(100 * (F.col("last") / F.col("first") - 1), 6).alias("change_pct"), F.round("vol", 6).alias("volatility"))


def recency(e: DataFrame, key: str, ts: str) -> DataFrame:
    """Each key's last time on a scale of 0 to 1 over all keys."""
    g = e.groupBy(key).agg(F.max(micros(F.col(ts))).alias("t"))
    ends = g.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return g.crossJoin(F.broadcast(ends)).select(key, F.round((F.col("t") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1_000_000)), 6).alias("recency"))  # one row


def rate_peaks(e: DataFrame, key: str, ts: str, id_col: str, seconds: int) -> DataFrame:
    """The most events of a key inside any span of so many seconds that ends with one of them."""
    w = Window.partitionBy(key).orderBy(micros(F.col(ts))).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return e.withColumn("_n", F.count("*").over(w)).groupBy(key).agg(F.max("_n").alias("peak"))


def sequences(e: DataFrame, key: str, order: list[str], kind: str, wanted: list[str]) -> DataFrame:
    """Rows after which a key's next rows are of the wanted kinds, one after the other, the row itself being the first."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = e.withColumns({f"_k{i}": F.lead(kind, i).over(w) for i in range(1, len(wanted))})
    hit = F.col(kind) == wanted[0]
    for i in range(1, len(wanted)):
        hit = hit & (F.col(f"_k{i}") == wanted[i])
    return marked.filter(hit).drop(*[f"_k{i}" for i in range(1, len(wanted))])


def chain_depths(t: DataFrame, key: str, place: str) -> DataFrame:
    """(key, depth, n): how far places follow one another from 0 without a gap, and how many rows that are there.

    Instead of a join for each step, rank is held against place: they agree as far as the chain goes.
    """
    places = t.select(key, place).groupBy(key, place).agg(F.count("*").alias("_n"))
    ranked = places.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(place)) - 1).filter(F.col("_r") == F.col(place))
    return ranked.groupBy(key).agg(F.max(place).cast("int").alias("depth"), F.sum("_n").alias("n"))


def summary(s: DataFrame, key: str, value: str, k: float) -> DataFrame:
    """Of each key: rows, rows beyond k sample deviations, their share, lowest, highest, mean, exact median, deviation."""
    g = s.groupBy(key).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_d"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("n"))
    odd = s.join(g.select(key, "_m", "_d"), key).groupBy(key).agg(F.count_if(F.abs(F.col(value) - F.col("_m")) > k * F.col("_d")).alias("anomalies"))
    r = lambda c, n: F.round(c, 4).alias(n)
    return g.join(odd, key).join(quantiles(s, key, value, {"_mid": 0.5}), key).select(key, "n", "anomalies", r(100.0 * F.col("anomalies") / F.col("n"), "pct"), r("_lo", "low"), r("_hi", "high"), r("_m", "mean"), r("_mid", "median"), r("_d", "deviation"))


def rates(e: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """(key, hour, increase, rate): how a running total grows in each hour that has rows, and by the second."""
    h = e.groupBy(key, F.date_trunc("hour", F.col(ts).cast("timestamp")).alias("hour")).agg(F.sum(value).alias("_s"))
    return h.select(key, "hour", F.round("_s", 4).alias("increase"), F.round(F.col("_s") / 3600, 8).alias("rate"))


def bucket_quantiles(e: DataFrame, key: str, value: str, bounds: list[float], shares: list[float]) -> DataFrame:
    """(key, q, value): quantiles from counts in buckets up to bounds, interpolated inside the bucket, as a histogram of a monitor gives them."""
    le = F.lit(float(bounds[-1]))
    for b in reversed(bounds[:-1]):
        le = F.when(F.col(value) <= b, F.lit(float(b))).otherwise(le)
    w = Window.partitionBy(key).orderBy("le")
    b = e.groupBy(key, le.alias("le")).agg(F.count("*").alias("n"))
    c = b.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(key))).withColumn("lo", F.coalesce(F.lag("le").over(w), F.lit(0.0)))
    q = c.withColumn("q", F.explode(F.array(*map(F.lit, shares)))).filter(F.col("upto") >= F.col("q") * F.col("total"))
    inside = F.col("lo") + (F.col("le") - F.col("lo")) * (F.col("q") * F.col("total") - (F.col("upto") - F.col("n"))) / F.col("n")
    return q.groupBy(key, "q").agg(F.round(F.min(inside), 6).alias("value"))


def mean_interval(e: DataFrame, key: str, value: str, z: float) -> DataFrame:
    """(key, low, high): mean and z standard errors, inside 0 and 1; a single row has an interval of a tenth on both sides."""
    g = e.groupBy(key).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_d"), F.count(value).alias("_n"))
    off = F.when(F.col("_n") > 1, z * F.col("_d") / F.sqrt("_n")).otherwise(0.1)
    return g.select(key, F.round(F.greatest(F.lit(0.0), F.col("_m") - off), 6).alias("low"), F.round(F.least(F.lit(1.0), F.col("_m") + off), 6).alias("high"))


def _sides(s: DataFrame, key: str, order: str, size: int, f, value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    before, behind = w.rowsBetween(-size, -1), w.rowsBetween(0, size - 1)
    both = s.withColumns({"_x": f(value).over(before), "_y": f(value).over(behind), "_a": F.count("*").over(before), "_b": F.count("*").over(behind)})
    return both.filter((F.col("_a") == size) & (F.col("_b") == size))


def level_shifts(s: DataFrame, key: str, order: str, value: str, size: int, share: float) -> DataFrame:
    """Rows where the mean of the next size rows differs by a share from that of the size rows before; shift is that share."""
    return _sides(s, key, order, size, F.avg, value).filter(F.abs(F.col("_y") - F.col("_x")) > share * F.col("_x")).select(key, order, F.round(F.try_divide(F.col("_y") - F.col("_x"), F.col("_x")), 6).alias("shift"))


def volatility_shifts(s: DataFrame, key: str, order: str, value: str, size: int, times: float) -> DataFrame:
    """Rows where the deviation of the next size rows is so many times that of the size rows before."""
    return _sides(s, key, order, size, F.stddev_samp, value).filter((F.col("_x") > 0) & (F.col("_y") > times * F.col("_x"))).select(key, order, F.round(F.col("_y") / F.col("_x"), 4).alias("ratio"))


def seasonal_outliers(e: DataFrame, ts: str, c: float) -> DataFrame:
    """(hour, residual): hours whose number of rows, less the mean of their hour of the day, lies beyond c interquartile ranges."""
    h = e.groupBy(F.date_trunc("hour", F.col(ts).cast("timestamp")).alias("hour")).agg(F.count("*").alias("_n"))
    m = h.groupBy(F.hour("hour").alias("_h")).agg(F.avg("_n").alias("_m"))
    r = h.join(F.broadcast(m), F.hour("hour") == F.col("_h")).select("hour", (F.col("_n") - F.col("_m")).alias("_r"), F.lit(0).alias("_k"))  # 24 rows
    q = quantiles(r, "_k", "_r", {"_a": 0.25, "_b": 0.75}).select("_a", "_b")
    out = r.drop("_k").crossJoin(F.broadcast(q)).filter((F.col("_r") > F.col("_b") + c * (F.col("_b") - F.col("_a"))) | (F.col("_r") < F.col("_a") - c * (F.col("_b") - F.col("_a"))))  # one row
    return out.select("hour", F.round("_r", 6).alias("residual"))


def baselines(s: DataFrame, lookback: int, price_pct: float, volume_pct: float) -> DataFrame:
    """(token, day, price_pct, volume_pct, pump): prices and volumes over the mean of the last lookback rows, this one included, once there are so many."""
    w = Window.partitionBy("token").orderBy("day").rowsBetween(-(lookback - 1), 0)
    p, v = 100 * (F.col("price") / F.avg("price").over(w) - 1), 100 * (F.col("volume") / F.avg("volume").over(w) - 1)
    b = s.select("token", "day", p.alias("_p"), v.alias("_v"), F.count("*").over(w).alias("_n")).filter(F.col("_n") == lookback)
    return b.select("token", "day", F.round("_p", 4).alias("price_pct"), F.round("_v", 4).alias("volume_pct"), ((F.col("_p") > price_pct) & (F.col("_v") > volume_pct)).alias("pump"))


def autoregression_outliers(s: DataFrame, key: str, order: str, value: str, k: float) -> DataFrame:
    """(key, order, residual): rows beyond k deviations from what a line through (row before, row) of their key gives; the first row has none."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    pairs = s.withColumn("_b", before).filter(F.col("_b").isNotNull())
    line = pairs.groupBy(key).agg(F.regr_slope(value, "_b").alias("_slope"), F.regr_intercept(value, "_b").alias("_start"))
    off = pairs.join(line, key).withColumn("_r", F.col(value) - (F.col("_start") + F.col("_slope") * F.col("_b")))
    spread = off.groupBy(key).agg(F.stddev_pop("_r").alias("_d"))
    return off.join(spread, key).filter(F.abs("_r") > k * F.col("_d")).select(key, order, F.round("_r", 3).alias("residual"))


def without_extremes(s: DataFrame, key: str, id_col: str, value: str, most: int, k: float, cut) -> DataFrame:
    """(key, id, round): values taken out one by one, each time a key's farthest from its mean, while it lies beyond k sample deviations of what is left.

    At most so many rounds; a round is a join of the rows with their key's mean and deviation. Of equally far values the smallest id goes.
    """
    left, found = s.select(key, id_col, value), None
    for n in range(1, most + 1):
        g = left.groupBy(key).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_d"))
        far = left.join(g, key).filter(F.col("_d") > 0).withColumn("_z", F.round(F.abs(F.col(value) - F.col("_m")) / F.col("_d"), 9)).filter(F.col("_z") > k)
        out = cut(far.groupBy(key).agg(F.min(F.struct(F.negate("_z").alias("z"), F.col(id_col).alias("i")))["i"].alias(id_col)).withColumn("round", F.lit(n)))
        found = out if found is None else found.unionByName(out)
        if out.isEmpty():
            break
        left = cut(left.join(out.select(key, id_col), [key, id_col], "left_anti"))
    return found


def generalised_esd(s: DataFrame, key: str, id_col: str, value: str, most: int, alpha: float, cut) -> DataFrame:
    """(key, id, round, deviate, critical): outliers by the generalised extreme studentized deviate test, at most `most` of each key.

    Each round takes out the value farthest from its key's mean (of equally far ones that with the smallest id) and notes its distance
    in sample deviations of what was left. The outliers are all that were taken up to the last round whose distance is over the critical
    value, which Student's t gives for the key's number of values. Null values are no values; a key without spread has no outliers.
    """
    left = cut(s.filter(F.col(value).isNotNull()).select(key, id_col, value))
    sizes, taken = left.groupBy(key).agg(F.count("*").alias("_n")), None
    for n in range(1, most + 1):
        g = left.groupBy(F.col(key).alias("_k")).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_d"))
        far = left.join(g, F.col(key).eqNullSafe(F.col("_k"))).filter(F.col("_d") > 0).select(key, id_col, F.round(F.abs(F.col(value) - F.col("_m")) / F.col("_d"), 9).alias("_z"))
        out = cut(far.groupBy(key).agg(F.min(F.struct(F.negate("_z").alias("z"), F.col(id_col).alias("i"))).alias("_o")).select(key, F.col("_o.i").alias(id_col), F.lit(n).alias("round"), F.negate("_o.z").alias("deviate")))
        taken = out if taken is None else taken.unionByName(out)
        if out.isEmpty():
            break
        left = cut(left.join(out.select(F.col(key).alias("_k"), F.col(id_col).alias("_i")), F.col(key).eqNullSafe(F.col("_k")) & (F.col(id_col) == F.col("_i")), "left_anti"))

    def critical(parts):
        from tracewright.functions.student import esd_critical

        known = {}
        for part in parts:
            pairs = list(zip(part["_n"].tolist(), part["round"].tolist(), strict=True))
            known |= {p: esd_critical(*p, alpha) for p in set(pairs) - known.keys()}
            yield part.drop(columns="_n").assign(critical=[known[p] for p in pairs])

    kinds = {f.name: f.dataType.simpleString() for f in taken.schema}
    judged = cut(taken.join(sizes.withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k"))).select(*taken.columns, "_n").mapInPandas(critical, ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", critical double"))
    last = judged.filter("deviate > critical").groupBy(F.col(key).alias("_k")).agg(F.max("round").alias("_last"))
    return judged.join(last, F.col(key).eqNullSafe(F.col("_k"))).filter(F.col("round") <= F.col("_last")).select(key, id_col, "round", "deviate", F.round("critical", 9).alias("critical"))
