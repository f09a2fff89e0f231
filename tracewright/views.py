"""Domain tables over the source tables: transfers, flows between users and nations, daily prices, balances, trades.

Each view exists twice: as a DataFrame, and as SQL text for the engine that results are compared with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(df: DataFrame, rows: int = 1_000_000) -> int:
    """Parts of about so many rows each, as many as cores at least, so that what a task sorts or groups doesn't grow with the table. Rows are counted from the files' footers."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each transfer: tx_id, src, dst, value, ts, token, tx_type, chain, status, quantity."""
    line, orders, customer = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer"))
    place = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = parts(line)
    placed = orders.join(customer.join(place, F.col("c_nationkey") == F.col("n_nationkey")), F.col("o_custkey") == F.col("c_custkey"))
    joined = line.repartition(n, "l_orderkey").join(placed.repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("tx_id"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("src"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("dst"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("token"),
        F.col("l_returnflag").alias("tx_type"),
        F.col("r_name").alias("chain"),
        F.col("l_linestatus").alias("status"),
        F.col("l_quantity").alias("quantity"),
    )


def transfers_with_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx_id of each transfer with label and nation of both ends: src_label, src_nation, dst_label, dst_nation.

    As transfers() joined with graph_nodes() twice, but payers meet orders and receivers meet lines by their own numbers, before texts are
    made, so that lines are shuffled twice and narrow.
    """
    line, orders, customer, supplier = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier"))
    place = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = parts(line)
    payer = customer.join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("src_nation"))
    receiver = supplier.join(place, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("dst_nation"))
    paid = orders.select("o_orderkey", "o_custkey").join(payer.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey").join(payer, F.col("o_custkey") == F.col("c_custkey"))
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    got = line.select(*keys).join(receiver, F.col("l_suppkey") == F.col("s_suppkey"))
    joined = got.repartition(n, "l_orderkey").join(paid.select("o_orderkey", "src_nation").repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.concat_ws("-", *[F.col(c).cast("string") for c in keys]).alias("tx_id"), F.lit("Customer").alias("src_label"), "src_nation", F.lit("Supplier").alias("dst_label"), "dst_nation")


def user_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each day, every event and the user of the next one: event_id, src, dst, value, ts, chain.

    A window runs within each minute; the last event of a minute gets the first of the day's next minute that has any, from a table of
    one row for each minute.
    """
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("_minute", F.date_trunc("minute", "ts"))
    nxt = F.lead("user_id").over(Window.partitionBy("_minute").orderBy("ts", "event_id"))
    last = F.lead("event_id").over(Window.partitionBy("_minute").orderBy("ts", "event_id")).isNull()
    firsts = events.groupBy("_minute").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("_user"))
    later = F.lead("_user").over(Window.partitionBy(F.to_date("_minute")).orderBy("_minute"))  # 1,440 rows a day at most
    firsts = firsts.select(F.col("_minute").alias("_of"), later.alias("_later"))
    joined = events.withColumns({"_next": nxt, "_last": last}).join(firsts, F.col("_minute").eqNullSafe(F.col("_of")))
    dst = F.when(F.col("_last"), F.col("_later")).otherwise(F.col("_next"))
    return joined.select("event_id", F.col("user_id").alias("src"), dst.alias("dst"), "value", "ts", F.col("event_type").alias("chain")).filter("dst is not null")


def nation_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flows between nations: src, dst, n, value; no loops."""
    line, orders, customer, supplier = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier"))
    return (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"))
        .agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("value"))
        .filter("src <> dst")
    )


def strong_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows between users by transfers of at least 95: src, dst, n, value, ts (the first); no loops. A sparse graph that grows with the table."""
    big = user_flow(spark, sf_dir).filter("value >= 95 AND src <> dst")
    return big.groupBy("src", "dst").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"), F.min("ts").alias("ts"))


def pair_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flows between users: src, dst, n, value, ts (the first); no loops."""
    return user_flow(spark, sf_dir).filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"), F.min("ts").alias("ts"))


def price_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean unit price and volume of each brand: token, day, price, volume."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return (
        line.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_brand").alias("token"), F.to_date("l_shipdate").alias("day"))
        .agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("price"), F.sum("l_quantity").alias("volume"))
    )


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each wallet holds of each token: wallet, token, amount."""
    held = transfers(spark, sf_dir).select(F.col("dst").alias("wallet"), "token", "value").repartition(parts(table(spark, sf_dir, "lineitem")), "wallet")
    return held.groupBy("wallet", "token").agg(F.round(F.sum("value"), 4).alias("amount"))


def _address(c: Column) -> Column:
    text = c.cast("string")
    return F.concat(F.lit("0x"), F.md5(text), F.substring(F.md5(F.concat(F.lit("x"), text)), 1, 8))


def raw_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a file of transfers holds them, all text, some of it broken: hash, from, to, value, timestamp, kind, token, chain."""
    e = table(spark, sf_dir, "events")
    every = lambda c, n: F.pmod(F.col(c), F.lit(n)) == 0
    return e.select(
        F.when(every("event_id", 29), None).otherwise(F.concat(F.lit("0x"), F.md5(F.col("event_id").cast("string")))).alias("hash"),
        F.when(every("user_id", 31), F.concat(F.lit("bad"), F.col("user_id").cast("string"))).otherwise(_address(F.col("user_id"))).alias("from"),
        _address(F.pmod("event_id", F.lit(97))).alias("to"),
        F.when(every("event_id", 17), "n/a").when(every("event_id", 19), "-5").otherwise(F.round(F.col("value") * 100).cast("long").cast("string")).alias("value"),
        F.when(every("event_id", 23), "unknown").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")).alias("timestamp"),
        F.when(F.col("event_type") == "click", "send").when(F.col("event_type") == "view", "receive").when(F.col("event_type") == "purchase", "swap").when(F.col("event_type") == "signup", "mint").otherwise("other").alias("kind"),
        F.concat(F.lit("T"), F.pmod("event_id", F.lit(7)).cast("string")).alias("token"),
        F.concat(F.lit("K"), F.pmod("user_id", F.lit(3)).cast("string")).alias("chain"),
    )


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ends of transfers: id, label, nation, chain, segment (null for suppliers), balance."""
    place = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    s = table(spark, sf_dir, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey"))
    shape = lambda prefix, key, label, segment, balance: [F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.lit(label).alias("label"), F.col("n_name").alias("nation"), F.col("r_name").alias("chain"), segment.alias("segment"), F.col(balance).alias("balance")]
    return c.select(*shape("C", "c_custkey", "Customer", F.col("c_mktsegment"), "c_acctbal")).unionByName(s.select(*shape("S", "s_suppkey", "Supplier", F.lit(None).cast("string"), "s_acctbal")))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and errors as trades on exchanges: place, block, dex, trader, bought, sold, amount, ts, failed."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select(
        F.col("event_id").alias("place"), F.date_trunc("hour", "ts").alias("block"), F.concat(F.lit("D"), F.pmod("event_id", F.lit(3)).cast("string")).alias("dex"), F.col("user_id").alias("trader"),
        F.concat(F.lit("T"), F.pmod("event_id", F.lit(4)).cast("string")).alias("bought"), F.concat(F.lit("T"), F.pmod(F.col("event_id") + F.col("user_id"), F.lit(4)).cast("string")).alias("sold"), F.col("value").alias("amount"), "ts", (F.col("event_type") == "error").alias("failed"),
    )


SQL = {
    "transfers": """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS tx_id, 'C' || o_custkey AS src, 'S' || l_suppkey AS dst,
      l_extendedprice * (1 - l_discount) AS value, l_shipdate AS ts, 'P' || l_partkey AS token, l_returnflag AS tx_type, r_name AS chain,
      l_linestatus AS status, l_quantity AS quantity
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "user_flow": """SELECT * FROM (SELECT event_id, user_id AS src, lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS dst,
      value, ts, event_type AS chain FROM events) WHERE dst IS NOT NULL""",
    "nation_flow": """SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS value
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
      WHERE c_nationkey <> s_nationkey GROUP BY 1, 2""",
    "strong_flow": """SELECT src, dst, count(*) AS n, round(sum(value), 2) AS value, min(ts) AS ts FROM user_flow WHERE value >= 95 AND src <> dst GROUP BY 1, 2""",
    "pair_flow": """SELECT src, dst, count(*) AS n, round(sum(value), 2) AS value, min(ts) AS ts FROM user_flow WHERE src <> dst GROUP BY 1, 2""",
    "price_series": """SELECT p_brand AS token, CAST(l_shipdate AS DATE) AS day, round(avg(l_extendedprice / l_quantity), 6) AS price, sum(l_quantity) AS volume
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "raw_transfers": """SELECT CASE WHEN event_id % 29 = 0 THEN NULL ELSE '0x' || md5(CAST(event_id AS VARCHAR)) END AS hash,
      CASE WHEN user_id % 31 = 0 THEN 'bad' || user_id ELSE '0x' || md5(CAST(user_id AS VARCHAR)) || substr(md5('x' || user_id), 1, 8) END AS "from",
      '0x' || md5(CAST(event_id % 97 AS VARCHAR)) || substr(md5('x' || (event_id % 97)), 1, 8) AS "to",
      CASE WHEN event_id % 17 = 0 THEN 'n/a' WHEN event_id % 19 = 0 THEN '-5' ELSE CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS value,
      CASE WHEN event_id % 23 = 0 THEN 'unknown' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS timestamp,
      CASE event_type WHEN 'click' THEN 'send' WHEN 'view' THEN 'receive' WHEN 'purchase' THEN 'swap' WHEN 'signup' THEN 'mint' ELSE 'other' END AS kind,
      'T' || (event_id % 7) AS token, 'K' || (user_id % 3) AS chain FROM events""",
    "graph_nodes": """SELECT 'C' || c_custkey AS id, 'Customer' AS label, n_name AS nation, r_name AS chain, c_mktsegment AS segment, c_acctbal AS balance
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
      UNION ALL SELECT 'S' || s_suppkey, 'Supplier', n_name, r_name, NULL, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "trades": """SELECT event_id AS place, date_trunc('hour', ts) AS block, 'D' || (event_id % 3) AS dex, user_id AS trader, 'T' || (event_id % 4) AS bought,
      'T' || ((event_id + user_id) % 4) AS sold, value AS amount, ts, event_type = 'error' AS failed FROM events""",
    "balances": """SELECT dst AS wallet, token, round(sum(value), 4) AS amount FROM transfers GROUP BY 1, 2""",
}


def with_views(sql: str) -> str:
    """Puts the views that a query names before it, as common table expressions."""
    above = {"transfers": ("balances",), "user_flow": ("strong_flow", "pair_flow")}
    used = [v for v in SQL if v in sql or any(x in sql for x in above.get(v, ()))]
    ctes = ", ".join(f"{v} AS ({SQL[v]})" for v in used)
    body = sql.strip()
    if not ctes:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"
