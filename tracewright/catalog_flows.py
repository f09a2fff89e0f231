"""Queries of joins, aggregates, windows and rankings over transfers, trades, prices and balances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tracewright import views
from tracewright.functions import scalars as X
from tracewright.operators import fraud, matching, profiles, series
from tracewright.operators.quantiles import at_index, quantiles
from tracewright.registry import on, query, source
from tracewright.views import parts, table

T, U, P, B, D, G = views.transfers, views.user_flow, views.price_series, views.balances, views.trades, views.graph_nodes
E = source("events")

# Filters

on(T, "f02_edge_properties", "SELECT tx_id FROM transfers WHERE tx_type = 'R' AND status <> 'O' AND quantity >= 40")(lambda t: t.filter((F.col("tx_type") == "R") & (F.col("status") != "O") & (F.col("quantity") >= 40)).select("tx_id"))
on(E, "f10_calendar", """SELECT event_id, hour(ts) BETWEEN 1 AND 5 AS night, isodow(ts) >= 6 AS weekend, round(value) % 10 = 0 AS rounded, abs(value - avg(value) OVER w) > 2 * stddev_pop(value) OVER w AS unusual FROM events WINDOW w AS (PARTITION BY event_type)""")(
    lambda e: e.select("event_id", F.hour("ts").between(1, 5).alias("night"), (F.weekday("ts") >= 5).alias("weekend"), (F.round("value") % 10 == 0).alias("rounded"), "event_type", "value")
    .join(e.groupBy("event_type").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_d")), "event_type").select("event_id", "night", "weekend", "rounded", (F.abs(F.col("value") - F.col("_m")) > 2 * F.col("_d")).alias("unusual"))
)
on(E, "f10_sequence", """SELECT event_id, user_id FROM (SELECT *, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'signup' AND b = 'purchase' AND c = 'error'""")(
    lambda e: series.sequences(e, "user_id", ["ts", "event_id"], "event_type", ["signup", "purchase", "error"]).select("event_id", "user_id")
)
on(E, "f15_lookback", "SELECT event_id FROM events WHERE epoch_us(ts) >= (SELECT max(epoch_us(ts)) FROM events) - 7 * 86400000000")(
    lambda e: e.crossJoin(F.broadcast(e.agg(F.max(X.micros(F.col("ts"))).alias("m")))).filter(X.micros(F.col("ts")) >= F.col("m") - 7 * 86_400_000_000).select("event_id")
)
on(views.raw_transfers, "f17_without_calls", "SELECT hash, kind FROM raw_transfers WHERE try_cast(value AS DOUBLE) >= 1000 AND kind <> 'other'")(lambda r: r.filter((F.col("value").try_cast("double") >= 1000) & (F.col("kind") != "other")).select("hash", "kind"))
on(E, "f26_tenant", "SELECT event_id FROM events WHERE user_id = 7 AND event_type = 'click'")(lambda e: profiles.of_tenant(e, "user_id", 7).filter("event_type = 'click'").select("event_id"))
on(D, "f29_block_range", "SELECT place FROM trades WHERE floor(epoch_us(block) / 3600000000) >= (SELECT max(floor(epoch_us(block) / 3600000000)) FROM trades) - 48")(lambda t: profiles.recent_blocks(t, "block", 48).select("place"))
query("f30_result_filters", "SELECT DISTINCT src AS wallet, chain FROM transfers WHERE lower(dst) = 's1'")(lambda s, d: T(s, d).filter(F.lower("dst") == "s1").select(F.col("src").alias("wallet"), "chain").distinct())

# Joins

on(U, "j02_reciprocal_pairs", """WITH p AS (SELECT least(a.src, a.dst) AS x, greatest(a.src, a.dst) AS y, a.value + b.value AS v FROM user_flow a JOIN user_flow b ON a.src = b.dst AND a.dst = b.src AND a.src <> a.dst
    AND b.ts >= a.ts AND epoch_us(b.ts) - epoch_us(a.ts) <= 86400000000 AND (a.ts < b.ts OR a.event_id < b.event_id))
  SELECT x AS a, y AS b, count(*) AS n, round(sum(v), 2) AS total, CASE WHEN count(*) > 20 THEN 'HIGH' WHEN count(*) > 10 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM p GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 10""")(
    lambda t: fraud.reciprocal_pairs(matching.reciprocal(t, 86_400, "event_id"), 1, 10)
)
on(U, "j05_layering_top", """SELECT a.event_id AS in_id, b.event_id AS out_id, round(abs(a.value - b.value) / nullif(a.value, 0), 6) AS off FROM user_flow a JOIN user_flow b ON a.dst = b.src AND a.event_id <> b.event_id AND b.ts >= a.ts AND epoch_us(b.ts) - epoch_us(a.ts) <= 3600000000
  WHERE a.src <> b.dst AND abs(a.value - b.value) / nullif(a.value, 0) < 0.1 ORDER BY off, in_id, out_id LIMIT 10""")(
    lambda t: matching.pass_through(t, 3600, "event_id").select(F.col("event_id1").alias("in_id"), F.col("event_id2").alias("out_id"), F.round("off", 6).alias("off")).orderBy("off", "in_id", "out_id").limit(10)
)
on(D, "j09_flash_loans", """WITH d AS (SELECT * REPLACE (date_trunc('day', block) AS block) FROM trades) SELECT a.trader, a.place AS first, m.place AS middle, b.place AS last FROM d a JOIN d b ON a.block = b.block AND a.dex = b.dex AND a.trader = b.trader AND a.bought = b.sold AND a.sold = b.bought AND a.place < b.place
  JOIN d m ON m.block = a.block AND m.dex = a.dex AND m.trader = a.trader AND a.place < m.place AND m.place < b.place WHERE a.bought <> a.sold""")(
    lambda t: fraud.between_trades(t.withColumn("block", F.date_trunc("day", "block"))).filter("middle_trader = trader").select("trader", "first", "middle", "last")
)
on(D, "j10_price_manipulation", """WITH d AS (SELECT * REPLACE (date_trunc('day', block) AS block) FROM trades) SELECT a.trader, a.block, count(*) AS n, count(DISTINCT m.trader) AS victims FROM d a JOIN d b ON a.block = b.block AND a.dex = b.dex AND a.trader = b.trader AND a.bought = b.sold AND a.sold = b.bought AND a.place < b.place
  JOIN d m ON m.block = a.block AND m.dex = a.dex AND a.place < m.place AND m.place < b.place WHERE a.bought <> a.sold AND m.trader <> a.trader GROUP BY 1, 2""")(
    lambda t: fraud.price_manipulation(t.withColumn("block", F.date_trunc("day", "block")))
)
on(U, "j12_layering_hops", """SELECT a.event_id AS id1, b.event_id AS id2, c.event_id AS id3 FROM user_flow a JOIN user_flow b ON a.dst = b.src AND b.ts > a.ts AND epoch_us(b.ts) - epoch_us(a.ts) <= 7200000000
  JOIN user_flow c ON b.dst = c.src AND c.ts > b.ts AND epoch_us(c.ts) - epoch_us(a.ts) <= 7200000000 AND epoch_us(c.ts) - epoch_us(b.ts) <= 7200000000 WHERE c.value >= 0.5 * a.value AND a.src <> c.dst""")(
    lambda t: fraud.hops(t, 3, 7200, "event_id").filter((F.col("value3") >= 0.5 * F.col("value1")) & (F.col("src1") != F.col("dst3"))).select(F.col("event_id1").alias("id1"), F.col("event_id2").alias("id2"), F.col("event_id3").alias("id3"))
)
on(U, "j13_mixer_hops", """SELECT a.event_id AS in_id, b.event_id AS out_id, a.dst AS mixer FROM user_flow a JOIN user_flow b ON a.dst = b.src AND b.ts > a.ts AND epoch_us(b.ts) - epoch_us(a.ts) <= 86400000000 WHERE a.dst IN (3, 5) AND a.src <> 3 AND b.dst <> a.src""")(
    lambda t: fraud.hops(t, 2, 86_400, "event_id").filter(F.col("dst1").isin(3, 5) & (F.col("src1") != 3) & (F.col("dst2") != F.col("src1"))).select(F.col("event_id1").alias("in_id"), F.col("event_id2").alias("out_id"), F.col("dst1").alias("mixer"))
)
on(U, "j14_round_trips", """SELECT a.event_id AS id1, c.event_id AS id3, a.src AS origin FROM user_flow a JOIN user_flow b ON a.dst = b.src AND b.ts > a.ts AND epoch_us(b.ts) - epoch_us(a.ts) <= 14400000000
  JOIN user_flow c ON b.dst = c.src AND c.ts > b.ts AND epoch_us(c.ts) - epoch_us(a.ts) <= 14400000000 WHERE c.dst = a.src AND a.src <> a.dst AND b.src <> b.dst AND c.src <> c.dst""")(
    lambda t: fraud.hops(t, 3, 14_400, "event_id").filter("dst3 = src1 AND src1 <> dst1 AND src2 <> dst2 AND src3 <> dst3").select(F.col("event_id1").alias("id1"), F.col("event_id3").alias("id3"), F.col("src1").alias("origin"))
)
query("j16_owned_accounts", """SELECT c_nationkey AS owner, count(DISTINCT o_custkey) AS accounts, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
  WHERE l_extendedprice < 10000 GROUP BY 1 HAVING count(*) >= 3""")(
    lambda s, d: table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).join(table(s, d, "lineitem").filter("l_extendedprice < 10000"), F.col("o_orderkey") == F.col("l_orderkey"))
    .groupBy(F.col("c_nationkey").alias("owner")).agg(F.countDistinct("o_custkey").alias("accounts"), F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total")).filter("n >= 3")
)
on(T, "j17_insiders", """WITH h AS (SELECT token, src AS wallet, min(ts) AS first_ts FROM transfers GROUP BY 1, 2), k AS (SELECT token, max(value / quantity) AS peak FROM transfers GROUP BY 1)
  SELECT t.token, t.src AS wallet, count(*) AS n, round(sum(t.value), 4) AS sold, round(max(t.value / t.quantity / peak), 6) AS of_peak FROM transfers t JOIN h ON t.token = h.token AND t.src = h.wallet JOIN k ON t.token = k.token WHERE t.ts > first_ts AND t.value / t.quantity >= 0.8 * peak GROUP BY 1, 2""")(
    lambda t: fraud.insiders(t.groupBy("token", F.col("src").alias("wallet")).agg(F.min("ts").alias("first_ts")), t.select("token", F.col("src").alias("wallet"), "ts", (F.col("value") / F.col("quantity")).alias("price"), F.col("value").alias("amount")), t.select("token", (F.col("value") / F.col("quantity")).alias("price")), 0.8)
)
on(T, "j20_abandoned", """WITH s AS (SELECT token, min(ts) AS a FROM transfers GROUP BY 1), e AS (SELECT max(ts) AS z FROM transfers), g AS (SELECT t.token, count(CASE WHEN t.ts <= a + INTERVAL 365 DAY THEN 1 END) AS early, count(CASE WHEN t.ts >= z - INTERVAL 365 DAY THEN 1 END) AS late FROM transfers t JOIN s ON t.token = s.token, e GROUP BY 1)
  SELECT * FROM g WHERE late < 0.5 * early""")(lambda t: fraud.abandoned(t, "token", 365, 365, 0.5))
query("j21_team_sales", """WITH u AS (SELECT token, sum(value) AS supply FROM transfers GROUP BY 1), g AS (SELECT token, sum(value) AS sold, count(DISTINCT src) AS sellers FROM transfers WHERE tx_type = 'R' GROUP BY 1) SELECT g.token, sellers, round(sold / supply, 6) AS share FROM g JOIN u ON g.token = u.token WHERE sold > 0.4 * supply""")(
    lambda s, d: fraud.team_sales((t := T(s, d)).filter("tx_type = 'R'").select("token", F.col("src").alias("wallet"), F.col("value").alias("amount")), t.groupBy("token").agg(F.sum("value").alias("supply")), 0.4)
)
query("j22_enriched", """WITH o AS (SELECT src, count(*) AS n_out FROM transfers GROUP BY 1), p AS (SELECT src, count(DISTINCT dst) AS partners FROM transfers GROUP BY 1) SELECT tx_id, coalesce(n_out, 0) AS src_out, coalesce(partners, 0) AS src_partners, round(coalesce(balance, 0.0), 2) AS dst_balance
  FROM transfers t LEFT JOIN o ON t.src = o.src LEFT JOIN p ON t.src = p.src LEFT JOIN graph_nodes n ON t.dst = n.id""")(
    lambda s, d: (t := T(s, d)).select("tx_id", "src", "dst").join(t.groupBy("src").agg(F.count("*").alias("src_out"), F.countDistinct("dst").alias("src_partners")), "src", "left")
    .join(G(s, d).select(F.col("id").alias("dst"), F.round("balance", 2).alias("dst_balance")), "dst", "left").fillna({"src_out": 0, "src_partners": 0, "dst_balance": 0.0}).select("tx_id", "src_out", "src_partners", "dst_balance")
)
query("j26_known_substrings", """SELECT page_id, k.name FROM pages JOIN (VALUES ('example.org'), ('.com/'), ('news')) AS k(name) ON contains(lower(url), k.name)""")(
    lambda s, d: table(s, d, "pages").select("page_id", F.explode(F.filter(F.array(*map(F.lit, ("example.org", ".com/", "news"))), lambda k: F.contains(F.lower("url"), k))).alias("name"))
)
on(source("conversations"), "j31_nested", """WITH u AS (SELECT conv_id, min(turn) AS first FROM conversations WHERE role = 'user' GROUP BY 1) SELECT u.conv_id, first, count(c.turn) AS answers, coalesce(string_agg(CAST(c.turn AS VARCHAR), ',' ORDER BY c.turn), '') AS turns FROM u LEFT JOIN conversations c ON u.conv_id = c.conv_id AND c.role = 'assistant' GROUP BY 1, 2""")(
    lambda c: c.filter("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("first")).join(c.filter("role = 'assistant'").groupBy("conv_id").agg(F.count("*").alias("answers"), F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda x: x.cast("string")), ",").alias("turns")), "conv_id", "left").fillna({"answers": 0, "turns": ""})
)
on(source("conversations"), "j29_answer_gap", """SELECT c.role, count(*) AS n, round(avg(d.turn - c.turn), 6) AS mean_gap FROM conversations c JOIN conversations d ON c.conv_id = d.conv_id AND d.turn = c.turn + 1 AND d.role <> c.role GROUP BY 1""")(
    lambda c: c.alias("c").join(c.alias("d"), (F.col("c.conv_id") == F.col("d.conv_id")) & (F.col("d.turn") == F.col("c.turn") + 1) & (F.col("d.role") != F.col("c.role"))).groupBy(F.col("c.role").alias("role")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("d.turn") - F.col("c.turn")), 6).alias("mean_gap"))
)
on(source("conversations"), "j28_parent_chains", """WITH RECURSIVE r(conv_id, turn, depth) AS (SELECT conv_id, turn, 0 FROM conversations WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn, depth + 1 FROM r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.turn + 1) SELECT conv_id, max(depth) AS depth, count(*) AS n FROM r GROUP BY 1""")(
    lambda c: series.chain_depths(c, "conv_id", "turn")
)

# Aggregates

query("a15_token_counts", """WITH s AS (SELECT src AS address, token, 1 AS o, 0 AS i FROM transfers UNION ALL SELECT dst, token, 0, 1 FROM transfers) SELECT address, count(DISTINCT token) AS tokens, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM s GROUP BY 1""")(lambda s, d: profiles.token_counts(T(s, d), parts(table(s, d, "lineitem"), 500_000)))
on(D, "a16_a17_traders", "SELECT trader, count(*) AS n, count(DISTINCT dex) AS dexes, count(DISTINCT u.token) AS tokens FROM (SELECT trader, dex, place, unnest([bought, sold]) AS token FROM trades) u GROUP BY 1")(
    lambda t: t.select("trader", "dex", "place", F.explode(F.array("bought", "sold")).alias("token")).groupBy("trader").agg(F.count("*").alias("n"), F.countDistinct("dex").alias("dexes"), F.countDistinct("token").alias("tokens"))
)
on(source("events"), "a18_column_profile", """SELECT 'value' AS name, count(*) - count(value) AS nulls, count(DISTINCT value) AS distinct_, round(min(value), 4) AS low, round(max(value), 4) AS high, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS deviation FROM events
  UNION ALL SELECT 'user_id', count(*) - count(user_id), count(DISTINCT user_id), min(user_id), max(user_id), round(avg(user_id), 6), round(median(user_id), 6), round(stddev_samp(user_id), 6) FROM events""")(lambda e: profiles.column_profile(e, ["value", "user_id"]))
on(source("events"), "a18_top_values", "SELECT name, value, n FROM (SELECT 'event_type' AS name, event_type AS value, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'user_id', CAST(user_id AS VARCHAR) AS u, count(*) AS n FROM events GROUP BY 2 ORDER BY n DESC, u LIMIT 5))")(
    lambda e: profiles.top_values(e, ["event_type", "user_id"], 5)
)
on(P, "a19_series_summary", """WITH g AS (SELECT token, avg(price) AS m, stddev_samp(price) AS d FROM price_series GROUP BY 1) SELECT p.token, count(*) AS n, count(CASE WHEN abs(price - m) > 2 * d THEN 1 END) AS anomalies, round(100.0 * count(CASE WHEN abs(price - m) > 2 * d THEN 1 END) / count(*), 4) AS pct,
  round(min(price), 4) AS low, round(max(price), 4) AS high, round(avg(price), 4) AS mean, round(median(price), 4) AS median, round(stddev_samp(price), 4) AS deviation FROM price_series p JOIN g ON p.token = g.token GROUP BY 1""")(lambda s: series.summary(s, "token", "price", 2.0))
on(T, "a22_wallet_chains", "SELECT src AS wallet, chain, round(sum(value), 4) AS usd, count(DISTINCT token) AS tokens, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM transfers GROUP BY 1, 2")(
    lambda t: t.groupBy(F.col("src").alias("wallet"), "chain").agg(F.round(F.sum("value"), 4).alias("usd"), F.countDistinct("token").alias("tokens"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n"))
)
on(T, "a26_whales_by_tier", """WITH g AS (SELECT src AS wallet, sum(value) AS s, count(CASE WHEN value >= 90000 THEN 1 END) AS k FROM transfers GROUP BY 1), w AS (SELECT wallet, CASE WHEN s >= 2000000 THEN 'TIER1' WHEN s >= 1000000 THEN 'TIER2' ELSE 'ACTIVE' END AS tier FROM g WHERE s >= 1000000 OR k > 0)
  SELECT tier, chain, count(DISTINCT w.wallet) AS wallets FROM w JOIN transfers t ON t.src = w.wallet WHERE tier <> 'ACTIVE' GROUP BY 1, 2""")(
    lambda t: profiles.whale_tiers(t, 2e6, 1e6, 9e4).filter("tier <> 'ACTIVE'").select("wallet", "tier").join(t.select(F.col("src").alias("wallet"), "chain").distinct(), "wallet").groupBy("tier", "chain").agg(F.count("*").alias("wallets"))
)
on(T, "a27_wallet_risk", """WITH g AS (SELECT src AS wallet, count(*) AS n, count(CASE WHEN status = 'O' THEN 1 END) AS low, count(CASE WHEN tx_type = 'A' THEN 1 END) AS approvals, count(CASE WHEN value > 60000 THEN 1 END) AS big, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS span FROM transfers GROUP BY 1),
  r AS (SELECT wallet, 2 * low + CASE WHEN low > 0.5 * n THEN 3 ELSE 0 END + CASE WHEN approvals > 5 THEN 2 ELSE 0 END + big + CASE WHEN n >= 2 AND span > 0 AND n / span * 86400 > 20 THEN 2 ELSE 0 END AS points FROM g) SELECT wallet, CAST(least(100, 5 * points) AS BIGINT) AS score, CASE WHEN 5 * points >= 75 THEN 'HIGH' WHEN 5 * points >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM r""")(
    lambda t: profiles.wallet_risk(t, F.col("status") == "O", F.col("tx_type") == "A", F.col("value") > 60000)
)
query("a30_token_risk", """SELECT p_partkey AS token, CAST(least(5, CASE WHEN p_retailprice < 950 THEN 3 ELSE 0 END + CASE WHEN p_size < 10 THEN 2 ELSE 0 END + CASE WHEN p_name IS NULL OR p_name = '' THEN 1 ELSE 0 END + CASE WHEN p_retailprice < 1e-6 THEN 1 ELSE 0 END) AS BIGINT) AS risk FROM part""")(
    lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("token"), profiles.token_risk(F.col("p_retailprice") < 950, F.col("p_size"), 10, F.col("p_name"), F.col("p_retailprice")).alias("risk"))
)
on(T, "a31_portfolio", "SELECT dst AS wallet, chain, round(sum(value), 4) AS total, count(CASE WHEN tx_type = 'N' THEN 1 END) AS native, count(CASE WHEN tx_type <> 'N' THEN 1 END) AS other, grouping(chain)::BIGINT AS level FROM transfers GROUP BY GROUPING SETS ((dst, chain), (dst))")(
    lambda t: t.groupingSets([["dst", "chain"], ["dst"]], "dst", "chain").agg(F.round(F.sum("value"), 4).alias("total"), F.count_if(F.col("tx_type") == "N").alias("native"), F.count_if(F.col("tx_type") != "N").alias("other"), F.grouping("chain").cast("long").alias("level")).withColumnRenamed("dst", "wallet")
)
query("a32_collectibles", "SELECT s_nationkey AS wallet, p_brand AS collection, p_size % 2 AS standard, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY GROUPING SETS ((s_nationkey, p_brand), (s_nationkey, p_size % 2))")(
    lambda s, d: table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("wallet"), F.col("p_brand").alias("collection"), (F.col("p_size") % 2).alias("standard"))
    .groupingSets([["wallet", "collection"], ["wallet", "standard"]], "wallet", "collection", "standard").agg(F.count("*").alias("n"))
)
on(views.raw_transfers, "a34_selectors", "SELECT token AS contract, substr(hash, 1, 10) AS selector, count(*) AS n, count(DISTINCT \"from\") AS callers FROM raw_transfers WHERE hash IS NOT NULL GROUP BY 1, 2")(
    lambda r: r.filter("hash is not null").groupBy(F.col("token").alias("contract"), F.substring("hash", 1, 10).alias("selector")).agg(F.count("*").alias("n"), F.countDistinct("from").alias("callers"))
)
on(T, "a36_wallet_summary", """WITH o AS (SELECT token, src AS owner FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY ts DESC, tx_id DESC) AS k FROM transfers) WHERE k = 1), g AS (SELECT src AS wallet, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT token) AS tokens FROM transfers GROUP BY 1)
  SELECT wallet, first_ts, last_ts, tokens, coalesce(n, 0) AS owned FROM g LEFT JOIN (SELECT owner, count(*) AS n FROM o GROUP BY 1) ON owner = wallet""")(profiles.wallet_summary)
query("a38_locked_value", "SELECT p_brand AS protocol, r_name AS chain, round(sum(l_extendedprice), 2) AS tvl FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")(
    lambda s, d: _protocols(s, d).groupBy("protocol", "chain").agg(F.round(F.sum("l_extendedprice"), 2).alias("tvl"))
)
query("a39_protocol_ratios", "SELECT p_brand AS protocol, round(sum(l_extendedprice), 2) AS tvl, round(sum(l_quantity) / nullif(sum(l_extendedprice), 0), 8) AS mcap_tvl, round(sum(p_retailprice) / nullif(sum(l_extendedprice), 0), 8) AS fdv_tvl FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")(
    lambda s, d: table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("protocol")).agg(F.sum("l_extendedprice").alias("_t"), F.sum("l_quantity").alias("_m"), F.sum("p_retailprice").alias("_f"))
    .select("protocol", F.round("_t", 2).alias("tvl"), F.round(F.try_divide("_m", "_t"), 8).alias("mcap_tvl"), F.round(F.try_divide("_f", "_t"), 8).alias("fdv_tvl"))
)


def _protocols(s, d: str) -> DataFrame:
    place = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(place, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("p_brand").alias("protocol"), F.col("r_name").alias("chain"), "l_extendedprice")


on(P, "a41_pump_days", """WITH k AS (SELECT token, max(price) AS peak FROM price_series GROUP BY 1), d AS (SELECT p.token, peak, min(day) AS peak_day FROM price_series p JOIN k ON p.token = k.token AND price = peak GROUP BY 1, 2)
  SELECT p.token, peak_day, round(peak, 6) AS peak, round(100 * (peak / min(CASE WHEN day < peak_day THEN price END) - 1), 4) AS pump_pct, round(100 * (1 - min(CASE WHEN day > peak_day THEN price END) / peak), 4) AS dump_pct FROM price_series p JOIN d ON p.token = d.token GROUP BY 1, 2, peak""")(fraud.pump_days)
on(D, "a42_coordinated_buys", "SELECT bought AS token, block, count(DISTINCT trader) AS buyers, round(sum(amount), 4) AS amount FROM trades GROUP BY 1, 2 HAVING count(DISTINCT trader) >= 2 ORDER BY buyers DESC, token, block LIMIT 10")(lambda t: fraud.coordinated_buys(t, 2, 10))
on(D, "a44_failed_sells", "WITH b AS (SELECT bought AS token, count(DISTINCT trader) AS buyers FROM trades WHERE NOT failed GROUP BY 1), s AS (SELECT sold AS token, count(DISTINCT trader) AS failed_sellers FROM trades WHERE failed GROUP BY 1) SELECT b.token, buyers, failed_sellers FROM b JOIN s ON b.token = s.token WHERE buyers >= 5 AND failed_sellers >= 3")(lambda t: fraud.failed_sells(t, 5, 3))
on(U, "a45_dust_campaigns", "WITH c AS (SELECT src, round(value, 0) AS size, count(*) AS n FROM user_flow WHERE value < 5 GROUP BY 1, 2) SELECT src, sum(n)::BIGINT AS n, max(n) AS alike FROM c GROUP BY 1 HAVING sum(n) >= 3 AND max(n) >= 2")(lambda t: fraud.dust_campaigns(t, 5, 3, 2))
query("a46_graph_statistics", "SELECT 'label' AS kind, label AS name, count(*) AS n FROM graph_nodes GROUP BY label UNION ALL SELECT 'chain', chain, count(*) FROM graph_nodes GROUP BY chain UNION ALL SELECT 'type', tx_type, count(*) FROM transfers GROUP BY tx_type")(
    lambda s, d: profiles.counts_by(G(s, d), {"label": "label", "chain": "chain"}).unionByName(profiles.counts_by(T(s, d), {"type": "tx_type"}))
)
query("a53_risk_histogram", "SELECT CAST(least(4, floor(value / 20)) AS INT) AS bin, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")(
    lambda s, d: table(s, d, "events").groupBy(F.least(F.lit(4), F.floor(F.col("value") / 20)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
)
on(E, "a54_status_pivot", "SELECT user_id, count(CASE WHEN event_type = 'error' THEN 1 END) AS error, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS purchase, count(CASE WHEN event_type = 'signup' THEN 1 END) AS signup FROM events GROUP BY 1")(
    lambda e: e.groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in ("error", "purchase", "signup")])
)
on(E, "a55_dashboard", "SELECT CASE WHEN value > 75 THEN 'HIGH' WHEN value > 40 THEN 'MEDIUM' ELSE 'LOW' END AS severity, event_type, date_trunc('week', ts) AS week, count(*) AS n, grouping_id(1, 2, 3)::BIGINT AS level FROM events GROUP BY GROUPING SETS ((1), (2), (3))".replace("grouping_id(1, 2, 3)::BIGINT AS level", "count(DISTINCT user_id) AS users"))(
    lambda e: e.select(X.ladder(F.col("value"), [(75, "HIGH"), (40, "MEDIUM")], "LOW").alias("severity"), "event_type", F.date_trunc("week", F.col("ts").cast("timestamp")).alias("week"), "user_id").groupingSets([["severity"], ["event_type"], ["week"]], "severity", "event_type", "week").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
)
on(E, "a56_scan_summary", "SELECT event_type, count(*) AS scanned, count(CASE WHEN value > 50 THEN 1 END) AS found FROM events GROUP BY 1")(lambda e: e.groupBy("event_type").agg(F.count("*").alias("scanned"), F.count_if(F.col("value") > 50).alias("found")))
on(E, "a57_rates", """WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour, sum(value) AS s, count(*) AS n FROM events GROUP BY 1, 2), c AS (SELECT *, sum(s) OVER w AS total FROM h WINDOW w AS (PARTITION BY event_type ORDER BY hour))
  SELECT event_type, hour, round(total - coalesce(lag(total) OVER (PARTITION BY event_type ORDER BY hour), 0), 4) AS increase, round(s / 3600, 8) AS rate FROM c""")(lambda e: series.rates(e, "event_type", "ts", "value"))
on(E, "a57_bucket_quantiles", """WITH b AS (SELECT event_type, CASE WHEN value <= 10 THEN 10 WHEN value <= 25 THEN 25 WHEN value <= 50 THEN 50 ELSE 100 END AS le, count(*) AS n FROM events GROUP BY 1, 2),
  c AS (SELECT *, sum(n) OVER w AS upto, sum(n) OVER (PARTITION BY event_type) AS total, coalesce(lag(le) OVER w, 0) AS lo FROM b WINDOW w AS (PARTITION BY event_type ORDER BY le)), q AS (SELECT unnest([0.5, 0.95, 0.99]) AS q)
  SELECT event_type, q, round(min(CASE WHEN upto >= q * total THEN lo + (le - lo) * (q * total - (upto - n)) / n END), 6) AS value FROM c, q GROUP BY 1, 2""")(lambda e: series.bucket_quantiles(e, "event_type", "value", [10, 25, 50, 100], [0.5, 0.95, 0.99]))
on(E, "a58_index_percentiles", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
  SELECT event_type, round(max(CASE WHEN i = floor(n * 0.95) THEN value END), 4) AS p95, round(max(CASE WHEN i = floor(n * 0.99) THEN value END), 4) AS p99 FROM r GROUP BY 1""")(
    lambda e: at_index(e, "event_type", "value", {"p95": 0.95, "p99": 0.99}).select("event_type", F.round("p95", 4).alias("p95"), F.round("p99", 4).alias("p99"))
)
on(E, "a61_mean_interval", """SELECT event_type, round(greatest(0, avg(value / 100) - 1.96 * stddev_samp(value / 100) / sqrt(count(*))), 6) AS low, round(least(1, avg(value / 100) + 1.96 * stddev_samp(value / 100) / sqrt(count(*))), 6) AS high FROM events GROUP BY 1""")(lambda e: series.mean_interval(e.withColumn("v", F.col("value") / 100), "event_type", "v", 1.96))
on(T, "a62_alerts", "SELECT tx_id, src, CASE WHEN value >= 90000 THEN 'HIGH' ELSE 'MEDIUM' END AS level FROM transfers WHERE value >= 60000")(lambda t: profiles.alerts(t, 60000, 1.5).select("tx_id", "src", "level"))
on(T, "a63_round_scan", "SELECT tx_id, quantity * 1000 AS amount, CASE WHEN quantity >= 40 THEN 'HIGH' WHEN quantity >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM transfers WHERE quantity * 1000 >= 10000 ORDER BY amount DESC, tx_id LIMIT 10")(
    lambda t: profiles.round_amounts(t, F.col("quantity") * 1000, 10000).select("tx_id", "amount", X.ladder(F.col("amount"), [(40000, "HIGH"), (20000, "MEDIUM")], "LOW", strict=False).alias("risk")).orderBy(F.desc("amount"), "tx_id").limit(10)
)
on(P, "a65_pump_summary", """WITH b AS (SELECT *, count(*) OVER w AS n, 100 * (price / avg(price) OVER w - 1) AS p, 100 * (volume / avg(volume) OVER w - 1) AS v FROM price_series WINDOW w AS (PARTITION BY token ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
  SELECT token, count(*) AS n, round(avg(p), 2) AS mean_price_pct, round(avg(v), 2) AS mean_volume_pct FROM b WHERE n = 5 AND p > 20 AND v > 50 GROUP BY 1""")(
    lambda s: series.pumps(s, 5, 20, 50, 15).groupBy("token").agg(F.count("*").alias("n"), F.round(F.avg("price_pct"), 2).alias("mean_price_pct"), F.round(F.avg("volume_pct"), 2).alias("mean_volume_pct"))
)
on(E, "a66_hourly", "SELECT event_type, date_trunc('hour', ts) AS hour, arg_max(value, (ts, event_id)) AS price, round(sum(value), 4) AS volume FROM events GROUP BY 1, 2")(lambda e: fraud.hourly_last(e, "event_type", "ts", "event_id", "value", "value"))
query("a69_latest_execution", "SELECT c_custkey AS query, o_orderkey AS execution, o_orderstatus AS status FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) ON o_custkey = c_custkey AND k = 1")(
    lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("query")).join(table(s, d, "orders").groupBy(F.col("o_custkey").alias("query")).agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("x")), "query", "left").select("query", F.col("x.o_orderkey").alias("execution"), F.col("x.o_orderstatus").alias("status"))
)
on(E, "a70_batch_rollup", "SELECT count(DISTINCT user_id) AS wallets, count(*) AS rows, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors FROM events")(lambda e: e.agg(F.countDistinct("user_id").alias("wallets"), F.count("*").alias("rows"), F.count_if(F.col("event_type") == "error").alias("errors")))

# Windows, rankings and sets

on(U, "w13_whale_windows", """WITH RECURSIVE m AS (SELECT event_id, src, epoch_us(ts) AS us, row_number() OVER (ORDER BY ts, event_id) AS k FROM user_flow WHERE value >= 90),
  x AS (SELECT a.k, (SELECT min(b.k) FROM m b WHERE b.us > a.us + 3600000000) AS next FROM m a), g(k, next) AS (SELECT k, next FROM x WHERE k = 1 UNION ALL SELECT x.k, x.next FROM g JOIN x ON x.k = g.next)
  SELECT any_value(a.event_id) AS anchor, count(*) AS n, count(DISTINCT m.src) AS parties FROM g JOIN m a ON a.k = g.k JOIN m ON m.k >= g.k AND (g.next IS NULL OR m.k < g.next) GROUP BY g.k HAVING count(*) >= 2""")(
    lambda t: fraud.whale_windows(t.filter("value >= 90").select(F.col("event_id").alias("id"), F.col("src").alias("party"), "ts"), 3600, 2)
)
on(E, "w14_retained", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 3")(lambda e: fraud.newest_per_key(e, "user_id", [F.desc("ts"), F.desc("event_id")], 3).select("event_id", "user_id"))
on(E, "w15_severity_ladder", "SELECT event_id, CASE WHEN value / 20 > 3 THEN 'CRITICAL' WHEN value / 20 > 2 THEN 'HIGH' WHEN value / 20 > 1.5 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM events")(lambda e: e.select("event_id", X.severity(F.col("value") / 20, 1.0).alias("severity")))
on(T, "t02_top_by_metric", """WITH g AS (SELECT src AS node, count(*) AS n, sum(value) AS v FROM transfers GROUP BY 1) SELECT 'n' AS metric, node, k AS rank FROM (SELECT node, row_number() OVER (ORDER BY n DESC, node) AS k FROM g) WHERE k <= 5 UNION ALL SELECT 'v', node, k FROM (SELECT node, row_number() OVER (ORDER BY v DESC, node) AS k FROM g) WHERE k <= 5""")(
    lambda t: profiles.top_by_metric(t.groupBy(F.col("src").alias("node")).agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("v")), "node", ["n", "v"], 5)
)
on(E, "t03_page", "SELECT event_id, value FROM events ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40")(lambda e: e.orderBy(F.desc("ts"), "event_id").offset(40).limit(20).select("event_id", "value"))
on(E, "t05_ordered_sample", "SELECT event_id FROM events ORDER BY event_id LIMIT 1000")(lambda e: e.select("event_id").orderBy("event_id").limit(1000))
query("t07_yield_pools", "SELECT p_partkey AS pool, round(p_size * 1.0, 2) AS apy FROM part WHERE p_retailprice BETWEEN 900 AND 1500 AND p_size BETWEEN 5 AND 45 ORDER BY p_size DESC, p_partkey LIMIT 20")(
    lambda s, d: table(s, d, "part").filter(F.col("p_retailprice").between(900, 1500) & F.col("p_size").between(5, 45)).orderBy(F.desc("p_size"), "p_partkey").limit(20).select(F.col("p_partkey").alias("pool"), F.col("p_size").cast("double").alias("apy"))
)
on(T, "t12_latest_of_address", "SELECT src, tx_id FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ts DESC, tx_id) AS r FROM transfers) WHERE r <= 10")(lambda t: fraud.newest_per_key(t, "src", [F.desc("ts"), F.col("tx_id")], 10).select("src", "tx_id"))
on(U, "u03_shared_hours", """WITH h AS (SELECT src, list_sort(list(DISTINCT hour(ts))) AS hours FROM user_flow GROUP BY 1), p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM user_flow WHERE src <> dst)
  SELECT a, b, round(len(list_intersect(x.hours, y.hours)) / len(list_distinct(list_concat(x.hours, y.hours))), 6) AS jaccard FROM p JOIN h x ON x.src = a JOIN h y ON y.src = b""")(lambda t: profiles.shared_hours(t))
query("u04_bundle_merge", "SELECT k, name FROM (SELECT k, name, row_number() OVER (PARTITION BY k ORDER BY p) AS r FROM (SELECT c_nationkey AS k, min(c_name) AS name, 1 AS p FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, min(s_name), 2 FROM supplier GROUP BY 1)) WHERE r = 1")(
    lambda s, d: profiles.first_bundle([table(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_name").alias("name")), table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_name").alias("name"))], "k")
)
query("u05_idle_parties", "SELECT id FROM graph_nodes WHERE id NOT IN (SELECT src FROM transfers WHERE value > 95000) AND id NOT IN (SELECT dst FROM transfers)")(
    lambda s, d: G(s, d).select("id").join(T(s, d).select(F.explode(F.array(F.when(F.col("value") > 95000, F.col("src")), F.col("dst"))).alias("id")).distinct(), "id", "left_anti")
)
on(P, "u07_any_detector", """WITH g AS (SELECT token, avg(price) AS m, stddev_samp(price) AS d, quantile_cont(price, 0.05) AS lo, quantile_cont(price, 0.95) AS hi FROM price_series GROUP BY 1) SELECT p.token, p.day FROM price_series p JOIN g ON p.token = g.token WHERE abs(price - m) > 3 * d OR price < lo OR price > hi""")(
    lambda s: series.threshold_outliers(s, "token", "day", "price").unionByName(series.quantile_outliers(s, "token", "day", "price")).distinct().select("token", "day")
)
on(E, "m04_unusual_amounts", "SELECT event_id FROM (SELECT event_id, value, avg(value) OVER (PARTITION BY event_type) AS m, stddev_pop(value) OVER (PARTITION BY event_type) AS d FROM events) WHERE abs(value - m) > 2 * d")(lambda e: series.zscores(e, "event_type", "event_id", "value", 2.0, 10).select("event_id"))
on(E, "m13_features", """SELECT event_id, round(ln(1 + value), 6) AS log_value, round(value, 1) AS rounded, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS weekday FROM events""")(
    lambda e: e.select("event_id", F.round(F.log1p("value"), 6).alias("log_value"), F.round("value", 1).alias("rounded"), F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"))
)
on(P, "m05_level_shift", """WITH w AS (SELECT *, avg(price) OVER a AS x, avg(price) OVER b AS y, count(*) OVER a AS n, count(*) OVER b AS m FROM price_series WINDOW a AS (PARTITION BY token ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY token ORDER BY day ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
  SELECT token, day, round((y - x) / x, 6) AS shift FROM w WHERE n = 10 AND m = 10 AND abs(y - x) > 0.2 * x""")(lambda s: series.level_shifts(s, "token", "day", "price", 10, 0.2))
on(P, "m05_volatility_shift", """WITH w AS (SELECT *, stddev_samp(price) OVER a AS x, stddev_samp(price) OVER b AS y, count(*) OVER a AS n, count(*) OVER b AS m FROM price_series WINDOW a AS (PARTITION BY token ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY token ORDER BY day ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
  SELECT token, day, round(y / x, 4) AS ratio FROM w WHERE n = 10 AND m = 10 AND x > 0 AND y > 3 * x""")(lambda s: series.volatility_shifts(s, "token", "day", "price", 10, 3.0))
on(E, "m05_seasonal", """WITH h AS (SELECT date_trunc('hour', ts) AS t, count(*) AS n FROM events GROUP BY 1), m AS (SELECT hour(t) AS h, avg(n) AS m FROM h GROUP BY 1), r AS (SELECT t, n - m AS r FROM h JOIN m ON hour(t) = m.h), q AS (SELECT quantile_cont(r, 0.25) AS a, quantile_cont(r, 0.75) AS b FROM r) SELECT t AS hour, round(r, 6) AS residual FROM r, q WHERE r > b + 1.5 * (b - a) OR r < a - 1.5 * (b - a)""")(lambda e: series.seasonal_outliers(e, "ts", 1.5))
on(E, "m15_rule_severity", "SELECT event_type, CASE WHEN n >= 100 AND v >= 5000 THEN 'CRITICAL' WHEN n >= 50 AND v >= 1000 THEN 'HIGH' WHEN n >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM (SELECT event_type, count(*) AS n, sum(value) AS v FROM events GROUP BY 1)")(
    lambda e: e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v")).select("event_type", X.rule_severity({"CRITICAL": {"n": 100, "v": 5000}, "HIGH": {"n": 50, "v": 1000}, "MEDIUM": {"n": 10}}).alias("severity"))
)
on(T, "g41_whale_candidates", "SELECT DISTINCT unnest([src, dst]) AS wallet FROM transfers WHERE value >= 80000 UNION SELECT * FROM (VALUES ('C1'), ('S1'))")(lambda t: profiles.whale_candidates(t, 80000, ["C1", "S1"]))
on(T, "g42_flow_edges", "SELECT tx_id, src, dst, round(value, 4) AS value, ts, chain FROM transfers")(lambda t: t.select("tx_id", "src", "dst", F.round("value", 4).alias("value"), "ts", "chain"))
on(U, "g38_coordination", """WITH e AS (SELECT 'DISTRIBUTION' AS kind, src AS party, dst AS other, CAST(floor(epoch_us(ts) / 7200000000) AS BIGINT) AS bucket FROM user_flow UNION ALL SELECT 'ACCUMULATION', dst, src, CAST(floor(epoch_us(ts) / 7200000000) AS BIGINT) FROM user_flow)
  SELECT kind, party, bucket, count(*) AS n, count(DISTINCT other) AS others, CASE WHEN count(*) >= 5 THEN 0.8 ELSE 0.6 END AS confidence FROM e GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND count(DISTINCT other) >= 2""")(lambda t: fraud.coordination(t, 7200, 2, 2))
on(E, "g39_parallel_chains", "SELECT user_id, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS bucket, count(DISTINCT event_type) AS chains FROM events GROUP BY 1, 2 HAVING count(DISTINCT event_type) >= 2")(lambda e: fraud.parallel_chains(e, "user_id", "ts", "event_type", 3600))
