"""The registered queries of the library, each with the SQL that its result is held against where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright import views
from tracewright.functions import scalars as X
from tracewright.operators import evaluation, graph, matching, profiles, retrieval, series, upserts
from tracewright.plans.patterns import Pattern, compile_pattern
from tracewright.registry import ORACLES, QUERIES, on, query, source  # noqa: F401
from tracewright.views import parts, table

FLAGSHIP = "a20_node_rollup"

T, U, N, P, B = views.transfers, views.user_flow, views.nation_flow, views.price_series, views.balances


# Filters and projections

on(T, "f06_threshold", "SELECT tx_id, src, dst, round(value, 4) AS value FROM transfers WHERE value >= 50000 AND value <= 90000")(
    lambda t: t.filter(F.col("value").between(50000, 90000)).select("tx_id", "src", "dst", F.round("value", 4).alias("value"))
)
on(T, "f08_structuring_band", "SELECT tx_id, src, round(value, 4) AS value FROM transfers WHERE value >= 8000 AND value < 10000")(
    lambda t: t.filter(X.structuring_band(F.col("value"))).select("tx_id", "src", F.round("value", 4).alias("value"))
)
on(T, "f16_trailing_window", "SELECT tx_id, ts FROM transfers WHERE ts >= (SELECT max(ts) FROM transfers) - INTERVAL 30 DAY")(
    lambda t: t.crossJoin(F.broadcast(t.agg(F.max("ts").alias("m")))).filter(F.col("ts") >= F.col("m") - F.expr("INTERVAL 30 DAYS")).select("tx_id", "ts")
)
on(T, "f18_round_amounts", "SELECT tx_id, quantity * 1000 AS amount FROM transfers WHERE quantity * 1000 >= 10000 AND (quantity * 1000) % 1000 = 0")(
    lambda t: profiles.round_amounts(t, F.col("quantity") * 1000, 10000).select("tx_id", "amount")
)
on(T, "f19_just_below", "SELECT tx_id, src, dst, round(value, 4) AS value FROM transfers WHERE (value > 9000 AND value < 10000) OR (value > 4500 AND value < 5000)")(profiles.just_below_amounts)
on(source("events"), "f20_event_filter", "SELECT event_id, event_type, user_id FROM events WHERE event_type IN ('purchase', 'error') AND value > 50")(
    lambda e: e.filter(F.col("event_type").isin("purchase", "error") & (F.col("value") > 50)).select("event_id", "event_type", "user_id")
)
on(source("events"), "p07_json_path", "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS k FROM events")(
    lambda e: e.select("event_id", F.coalesce(F.expr("try_cast(get_json_object(props, '$.k') AS DOUBLE)"), F.lit(0.0)).alias("k"))
)
on(T, "m12_transfer_features", """SELECT tx_id, CAST(month(ts) AS INT) AS month, CAST(isodow(ts) - 1 AS INT) AS weekday, isodow(ts) >= 6 AS weekend,
  CASE WHEN value <= 0 THEN 0 WHEN value <= 1000 THEN 1 WHEN value <= 5000 THEN 2 WHEN value <= 10000 THEN 3 WHEN value <= 50000 THEN 4 ELSE 5 END AS bin,
  round(ln(1 + value), 6) AS log_value FROM transfers""")(
    lambda t: t.select("tx_id", F.month("ts").alias("month"), F.weekday("ts").alias("weekday"), (F.weekday("ts") >= 5).alias("weekend"), X.amount_bin(F.col("value")).alias("bin"), F.round(F.log1p("value"), 6).alias("log_value"))
)

# Aggregates

on(T, "a02_smurfing", """SELECT src, dst, n, total, mean, first_ts, last_ts, CASE WHEN n > 50 THEN 0.9 WHEN n > 30 THEN 0.7 WHEN n > 20 THEN 0.5 ELSE 0.3 END AS confidence FROM
  (SELECT src, dst, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(ts) AS first_ts, max(ts) AS last_ts FROM transfers GROUP BY 1, 2)
  WHERE n > 1 AND last_ts - first_ts < INTERVAL 365 DAY""")(lambda t: profiles.repeated_pairs(t, 1, 365))
on(T, "a03_smurfing_top10", "SELECT src, dst, count(*) AS n, round(sum(value), 4) AS total FROM transfers GROUP BY 1, 2 ORDER BY n DESC, src, dst LIMIT 10")(
    lambda t: t.groupBy("src", "dst").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).orderBy(F.desc("n"), "src", "dst").limit(10)
)
on(T, "a04_high_frequency", "SELECT src, n, total, CASE WHEN n > 80 THEN 'HIGH' WHEN n > 60 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM (SELECT src, count(*) AS n, round(sum(value), 4) AS total FROM transfers GROUP BY 1) WHERE n > 40")(
    lambda t: profiles.senders_by_count(t, 40, 80, 60)
)
on(T, "a05_structuring", "SELECT src, count(*) AS n, round(sum(value), 4) AS total FROM transfers WHERE value >= 8000 AND value < 10000 GROUP BY 1 HAVING count(*) >= 3")(lambda t: profiles.structuring(t, 3))
on(T, "a06_smurf_targets", "SELECT dst, count(DISTINCT src) AS sources, count(*) AS n, round(sum(value), 4) AS total FROM transfers GROUP BY 1 HAVING count(DISTINCT src) >= 20 AND count(*) >= 50")(
    lambda t: profiles.smurf_targets(t, 20, 50)
)
on(T, "a07_velocity", "SELECT src, count(*) AS n, round(sum(value), 4) AS total, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0, 4) AS span_hours FROM transfers GROUP BY 1 HAVING count(*) > 30 AND round(sum(value), 4) > 1000000")(
    lambda t: profiles.velocity(t, 30, 1e6)
)
on(U, "a08_hourly_peaks", """WITH h AS (SELECT src, date_trunc('hour', ts) AS hour, count(*) AS n FROM user_flow GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, hour) AS k FROM h),
  g AS (SELECT src, max(n) AS peak, round(avg(n), 6) AS mean FROM h GROUP BY 1)
  SELECT g.src, peak, mean, hour AS peak_hour FROM g JOIN r ON g.src = r.src AND k = 1 WHERE peak > 1 AND peak > 1.5 * mean""")(lambda t: profiles.hourly_peaks(t, 1, 1.5))
on(U, "a09_usual_hours", """WITH h AS (SELECT src, hour(ts) AS h, count(*) AS n FROM user_flow GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, h) AS k FROM h)
  SELECT src, string_agg(CAST(h AS VARCHAR), ',' ORDER BY h) AS hours FROM r WHERE k <= 3 GROUP BY 1""")(profiles.usual_hours)
on(U, "j25_outside_usual_hours", """WITH h AS (SELECT src, hour(ts) AS h, count(*) AS n FROM user_flow GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, h) AS k FROM h)
  SELECT u.event_id, u.src, CAST(hour(u.ts) AS INT) AS h FROM user_flow u WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.src = u.src AND r.h = hour(u.ts) AND k <= 3)""")(
    lambda t: profiles.outside_usual_hours(t, "event_id")
)
query("a10_a14_flow_profile", """WITH o AS (SELECT src AS address, count(*) AS n_out, sum(value) AS ov, count(DISTINCT dst) AS partners_out FROM transfers GROUP BY 1),
  i AS (SELECT dst AS address, count(*) AS n_in, sum(value) AS iv, count(DISTINCT src) AS partners_in FROM transfers GROUP BY 1)
  SELECT coalesce(o.address, i.address) AS address, coalesce(n_out, 0) AS n_out, coalesce(partners_out, 0) AS partners_out, coalesce(n_in, 0) AS n_in, coalesce(partners_in, 0) AS partners_in,
  round(coalesce(ov, 0.0), 4) AS out_value, round(coalesce(iv, 0.0), 4) AS in_value, round(coalesce(iv, 0.0) - coalesce(ov, 0.0), 4) AS net_flow FROM o FULL JOIN i ON o.address = i.address""")(lambda s, d: profiles.flow_profile(T(s, d), parts(table(s, d, "lineitem"), 500_000)))
on(T, FLAGSHIP, """WITH s AS (SELECT src AS address, 0.0 AS i, value AS o, chain, ts FROM transfers UNION ALL SELECT dst, value, 0.0, chain, ts FROM transfers),
  r AS (SELECT address, sum(i) AS i, sum(o) AS o, count(*) AS n_tx, sum(CASE WHEN i > 0 THEN 1 ELSE 0 END) AS n_in, sum(CASE WHEN o > 0 THEN 1 ELSE 0 END) AS n_out,
    string_agg(DISTINCT chain, ',' ORDER BY chain) AS chains, count(DISTINCT chain) AS nc, min(ts) AS first_seen, max(ts) AS last_seen FROM s GROUP BY 1)
  SELECT address, round(i, 4) AS in_usd, round(o, 4) AS out_usd, round(i - o, 4) AS net_usd, n_tx, chains, first_seen, last_seen,
    CASE WHEN i - o > 0 AND i - o > 0.8 * i THEN 'ACCUMULATOR' WHEN i - o < 0 AND abs(i - o) > 0.8 * o THEN 'SOURCE' ELSE 'NEUTRAL' END AS label,
    CAST(least(100, CASE WHEN n_in >= 5 THEN least(20, n_in) ELSE 0 END + CASE WHEN n_out >= 5 THEN least(20, n_out) ELSE 0 END + CASE WHEN nc > 1 THEN 5 * nc ELSE 0 END
      + CASE WHEN i + o > 1e6 THEN 25 WHEN i + o > 1e5 THEN 15 WHEN i + o > 1e4 THEN 5 ELSE 0 END
      + CASE WHEN greatest(i, o) > 0 AND least(i, o) / greatest(i, o) > 0.9 THEN 20 WHEN greatest(i, o) > 0 AND least(i, o) / greatest(i, o) > 0.7 THEN 10 ELSE 0 END) AS BIGINT) AS risk FROM r""")(profiles.node_rollup)
on(T, "a21_flow_metrics", """WITH m AS (SELECT sum(value) AS t, avg(value) AS a, max(value) AS x, count(*) AS n, count(DISTINCT chain) AS chains, count(DISTINCT (src, dst)) AS e, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0 AS h FROM transfers),
  d AS (SELECT count(DISTINCT a) AS addresses FROM (SELECT src AS a FROM transfers UNION ALL SELECT dst FROM transfers))
  SELECT round(t, 4) AS total_usd, round(a, 4) AS mean_usd, round(x, 4) AS max_usd, n, addresses, chains, round(h, 4) AS hours, round(n / h, 6) AS tx_per_hour, round(t / h, 4) AS usd_per_hour, round(e / (addresses * (addresses - 1)), 8) AS density FROM m, d""")(profiles.flow_metrics)
on(T, "a23_bridge_usage", """WITH b AS (SELECT *, CASE WHEN dst IN ('S1', 'S2', 'S3') THEN dst ELSE 'unknown' END AS bridge FROM transfers),
  g AS (SELECT chain, bridge, count(*) AS n, sum(value) AS s, avg(value) AS m, min(ts) AS first_ts, max(ts) AS last_ts FROM b GROUP BY 1, 2)
  SELECT chain, bridge, n, round(s, 4) AS total, round(m, 4) AS mean, first_ts, last_ts, CAST(least(100, CASE WHEN bridge = 'unknown' THEN 30 ELSE 0 END + CASE WHEN n > 10 THEN 20 WHEN n > 5 THEN 10 ELSE 0 END
    + CASE WHEN m > 50000 THEN 20 WHEN m > 10000 THEN 10 ELSE 0 END) AS BIGINT) AS risk FROM g""")(lambda t: profiles.bridge_usage(t, ["S1", "S2", "S3"]))
on(T, "a24_whale_tiers", """WITH g AS (SELECT src AS wallet, sum(value) AS s, sum(CASE WHEN value >= 90000 THEN 1 ELSE 0 END)::BIGINT AS n_large, max(ts) AS last_active, count(DISTINCT chain) AS chains FROM transfers GROUP BY 1)
  SELECT wallet, round(s, 4) AS total, n_large, last_active, chains, CASE WHEN s >= 2000000 THEN 'TIER1' WHEN s >= 1000000 THEN 'TIER2' ELSE 'ACTIVE' END AS tier FROM g WHERE s >= 1000000 OR n_large > 0""")(lambda t: profiles.whale_tiers(t, 2e6, 1e6, 9e4))
on(T, "a25_movement_stats", """SELECT tx_type, chain, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, grouping(tx_type, chain)::BIGINT AS level FROM transfers GROUP BY CUBE (tx_type, chain)""")(profiles.movement_stats)
on(B, "a28_a29_holder_concentration", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY amount, wallet) AS i, row_number() OVER (PARTITION BY token ORDER BY amount DESC, wallet) AS k, count(*) OVER (PARTITION BY token) AS n FROM balances),
  g AS (SELECT token, max(n) AS holders, sum(amount) AS s, sum(i * amount) AS w, sum(CASE WHEN k <= greatest(1, floor(n * 0.01)) THEN amount ELSE 0.0 END) AS t1, sum(CASE WHEN k <= greatest(1, floor(n * 0.1)) THEN amount ELSE 0.0 END) AS t10 FROM r GROUP BY 1),
  o AS (SELECT token, holders, round(2 * w / (holders * s) - (holders + 1) / holders, 4) AS gini, round(100 * t1 / s, 2) AS top1_pct, round(100 * t10 / s, 2) AS top10_pct FROM g)
  SELECT *, CAST(least(10, CASE WHEN gini > 0.7 THEN 5 WHEN gini > 0.5 THEN 3 ELSE 0 END + CASE WHEN top1_pct > 50 THEN 4 WHEN top1_pct > 20 THEN 2 ELSE 0 END + CASE WHEN top10_pct > 80 THEN 3 WHEN top10_pct > 50 THEN 1 ELSE 0 END) AS BIGINT) AS risk FROM o""")(profiles.holder_concentration)
on(B, "w10_top_holders", "SELECT * FROM (SELECT wallet, token, amount, CAST(row_number() OVER (PARTITION BY token ORDER BY amount DESC, wallet) AS INT) AS rank FROM balances) WHERE rank <= 5")(profiles.top_holders)
on(T, "a35_related_addresses", """SELECT address, partner, sum(o)::BIGINT AS n_out, sum(1 - o)::BIGINT AS n_in, round(sum(value), 4) AS total, min(ts) AS first_ts, max(ts) AS last_ts FROM
  (SELECT src AS address, dst AS partner, 1 AS o, value, ts FROM transfers UNION ALL SELECT dst, src, 0, value, ts FROM transfers) GROUP BY 1, 2""")(profiles.related_addresses)
on(T, "a37_chain_dominance", "SELECT chain, round(sum(value), 4) AS total, round(100 * sum(value) / (SELECT sum(value) FROM transfers), 4) AS pct FROM transfers GROUP BY 1")(lambda t: profiles.dominance(t, "chain"))
on(T, "a33_token_rollup", "SELECT token, round(sum(value), 4) AS volume, count(DISTINCT src) AS senders, count(DISTINCT dst) AS receivers FROM transfers GROUP BY 1")(
    lambda t: t.groupBy("token").agg(F.round(F.sum("value"), 4).alias("volume"), F.countDistinct("src").alias("senders"), F.countDistinct("dst").alias("receivers"))
)
on(T, "a43_net_positions", """WITH g AS (SELECT token, chain, sum(CASE WHEN tx_type = 'N' THEN value END) AS b, sum(CASE WHEN tx_type <> 'N' THEN value END) AS s, count(CASE WHEN tx_type = 'N' THEN 1 END) AS buys, count(CASE WHEN tx_type <> 'N' THEN 1 END) AS sells FROM transfers GROUP BY 1, 2)
  SELECT token, chain, round(b, 4) AS bought, round(s, 4) AS sold, buys, sells FROM g WHERE buys > 1 AND sells > 1 AND abs(b - s) < 0.1 * greatest(b, s)""")(lambda t: profiles.net_positions(t, 1))
on(source("events"), "a48_latency", """SELECT user_id, count(*) AS n, round(avg(value), 4) AS mean, round(min(value), 4) AS least, round(max(value), 4) AS most, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS failed_share, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY 1""")(
    lambda e: evaluation.latency(e, "user_id", "value", F.col("event_type") == "error")
)
on(source("events"), "a55_event_trend", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")(
    lambda e: e.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day"), "event_type").agg(F.count("*").alias("n"))
)
query("a59_confusion", """WITH p AS (SELECT quality AS label, CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS predicted FROM labels JOIN documents USING (doc_id)),
  g AS (SELECT sum(CASE WHEN label = 1 AND predicted = 1 THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN label = 0 AND predicted = 1 THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN label = 1 AND predicted = 0 THEN 1 ELSE 0 END)::BIGINT AS fn, sum(CASE WHEN label = 0 AND predicted = 0 THEN 1 ELSE 0 END)::BIGINT AS tn FROM p)
  SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM g""")(
    lambda s, d: evaluation.confusion(table(s, d, "labels").join(table(s, d, "documents"), "doc_id").select(F.col("quality").alias("label"), (F.col("n_chars") >= 1000).cast("int").alias("predicted")))
)
query("a59_roc_auc", """WITH p AS (SELECT quality AS label, n_chars AS score FROM labels JOIN documents USING (doc_id)),
  g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM p GROUP BY 1),
  w AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
  SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc FROM w""")(
    lambda s, d: evaluation.roc_auc(table(s, d, "labels").join(table(s, d, "documents"), "doc_id").select(F.col("quality").alias("label"), F.col("n_chars").alias("score")))
)
on(source("labels"), "a60_class_distribution", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")(lambda t: t.groupBy("quality", "toxic").agg(F.count("*").alias("n")))

# Joins

on(U, "j01_wash_addresses", """WITH p AS (SELECT a.src AS address, a.dst AS d, a.value + b.value AS v FROM user_flow a JOIN user_flow b ON a.src = b.dst AND a.dst = b.src AND a.src <> a.dst
    AND b.ts >= a.ts AND epoch_us(b.ts) - epoch_us(a.ts) <= 86400000000 AND (a.ts < b.ts OR a.event_id < b.event_id)),
  q AS (SELECT address, count(*) AS n, round(sum(v), 2) AS total FROM p GROUP BY 1),
  l AS (SELECT address, string_agg(CAST(d AS VARCHAR), ',' ORDER BY d) AS partners FROM (SELECT address, d, row_number() OVER (PARTITION BY address ORDER BY d) AS k FROM (SELECT DISTINCT address, d FROM p)) WHERE k <= 5 GROUP BY 1)
  SELECT address, n, total, partners, CASE WHEN n > 20 THEN 0.9 WHEN n > 10 THEN 0.7 WHEN n > 5 THEN 0.5 ELSE 0.3 END AS confidence, n > 5 AS suspicious FROM q JOIN l USING (address)""")(lambda t: matching.wash_addresses(t, 86_400, "event_id"))
on(U, "j03_self_dealing", """SELECT a.event_id AS first_id, b.event_id AS second_id FROM user_flow a JOIN user_flow b ON a.src = b.dst AND a.dst = b.src AND a.src <> a.dst
  AND b.ts >= a.ts AND epoch_us(b.ts) - epoch_us(a.ts) <= 86400000000 AND (a.ts < b.ts OR a.event_id < b.event_id) WHERE abs(a.value - b.value) < 0.1 * a.value""")(
    lambda t: matching.reciprocal(t, 86_400, "event_id", 0.1).select(F.col("event_id1").alias("first_id"), F.col("event_id2").alias("second_id"))
)
on(U, "j04_pass_through", """WITH p AS (SELECT a.event_id AS in_id, b.event_id AS out_id, abs(a.value - b.value) / nullif(a.value, 0) AS off, (epoch_us(b.ts) - epoch_us(a.ts)) / 1000000.0 AS gap FROM user_flow a JOIN user_flow b
    ON a.dst = b.src AND a.event_id <> b.event_id AND b.ts >= a.ts AND epoch_us(b.ts) - epoch_us(a.ts) <= 3600000000 WHERE a.src <> b.dst)
  SELECT in_id, out_id, round(off, 6) AS off, CASE WHEN off < 0.01 AND gap < 60 THEN 0.9 WHEN off < 0.05 AND gap < 600 THEN 0.7 WHEN off < 0.1 AND gap < 3600 THEN 0.5 ELSE 0.3 END AS confidence FROM p WHERE off < 0.1""")(
    lambda t: matching.pass_through(t, 3600, "event_id").select(F.col("event_id1").alias("in_id"), F.col("event_id2").alias("out_id"), F.round("off", 6).alias("off"), "confidence")
)
on(U, "j06_cross_chain", """WITH p AS (SELECT a.event_id AS out_id, b.event_id AS in_id, a.src AS wallet, a.chain AS from_chain, b.chain AS to_chain, a.value AS v1, least(a.value, b.value) / greatest(a.value, b.value) AS r, (epoch_us(b.ts) - epoch_us(a.ts)) / 1000000.0 AS gap, a.dst IN (1, 2, 3) AS bridge
    FROM user_flow a JOIN user_flow b ON a.src = b.dst AND a.chain <> b.chain AND a.event_id <> b.event_id AND b.ts >= a.ts AND epoch_us(b.ts) - epoch_us(a.ts) <= 900000000 WHERE a.value >= 10 AND b.value >= 10)
  SELECT out_id, in_id, wallet, from_chain, to_chain, round(r, 6) AS ratio, round(least(1.0, 0.5 + CASE WHEN bridge THEN 0.3 ELSE 0 END + CASE WHEN r > 0.9 THEN 0.2 WHEN r > 0.7 THEN 0.1 ELSE 0 END + CASE WHEN gap < 300 THEN 0.1 ELSE 0 END), 2) AS confidence,
  CAST(least(100, CASE WHEN v1 > 100000 THEN 30 WHEN v1 > 10000 THEN 10 ELSE 0 END + CASE WHEN bridge THEN 0 ELSE 20 END + CASE WHEN gap < 120 THEN 10 ELSE 0 END) AS BIGINT) AS risk FROM p""")(
    lambda t: matching.cross_chain(t, 900, 10.0, [1, 2, 3], "event_id")
)
query("j07_j08_sandwich", """WITH t AS (SELECT date_trunc('hour', ts) AS block, event_type AS pool, event_id AS place, user_id % 7 AS trader, CASE WHEN value >= 30 THEN 'buy' ELSE 'sell' END AS side FROM events WHERE event_type IN ('purchase', 'error'))
  SELECT a.trader, count(*) AS n, count(DISTINCT v.trader) AS victims FROM t a JOIN t b ON a.block = b.block AND a.pool = b.pool AND a.trader = b.trader AND a.place < b.place AND a.side <> b.side
  JOIN t v ON v.block = a.block AND v.pool = a.pool AND a.place < v.place AND v.place < b.place AND v.trader <> a.trader AND v.side = a.side GROUP BY 1""")(
    lambda s, d: matching.sandwiches(
        table(s, d, "events").filter(F.col("event_type").isin("purchase", "error")).select(
            F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("block"), F.col("event_type").alias("pool"), F.col("event_id").alias("place"), F.pmod("user_id", F.lit(7)).alias("trader"), F.when(F.col("value") >= 30, "buy").otherwise("sell").alias("side")
        )
    )
)
on(views.strong_flow, "j11_money_rings", """SELECT x.src AS a, y.src AS b, z.src AS c, round(x.value + y.value + z.value, 2) AS total FROM strong_flow x JOIN strong_flow y ON x.dst = y.src AND x.ts < y.ts JOIN strong_flow z ON y.dst = z.src AND z.dst = x.src AND y.ts < z.ts
  WHERE x.value > 96 AND y.value > 96 AND z.value > 96""")(lambda e: matching.rings(e, 96))
on(T, "j15_reversed_structuring", """WITH w AS (SELECT src AS account, max(ts) AS out_ts, round(max(value), 2) AS largest FROM transfers WHERE tx_type = 'R' AND value >= 60000 GROUP BY 1)
  SELECT d.src AS account, largest, count(*) AS n, round(sum(d.value), 2) AS total FROM transfers d JOIN w ON d.src = w.account AND d.ts < w.out_ts WHERE d.tx_type = 'N' AND d.value < 10000 GROUP BY 1, 2 HAVING count(*) >= 2""")(
    lambda t: matching.reversed_structuring(t.filter("tx_type = 'N'").withColumn("account", F.col("src")), t.filter("tx_type = 'R'").withColumn("account", F.col("src")), 10000, 60000, 2)
)
query("j18_dust_then_reply", """WITH d AS (SELECT event_id, src, dst, ts FROM user_flow WHERE value < 5), h AS (SELECT DISTINCT d.event_id FROM d JOIN user_flow r ON d.dst = r.src AND r.ts > d.ts AND epoch_us(r.ts) - epoch_us(d.ts) <= 86400000000)
  SELECT src AS sender, count(DISTINCT dst) AS targets, sum(CASE WHEN h.event_id IS NULL THEN 0 ELSE 1 END)::BIGINT AS replies FROM d LEFT JOIN h ON d.event_id = h.event_id GROUP BY 1""")(lambda s, d: matching.dust_then_reply(U(s, d), 5, 1, "event_id"))
on(T, "j19_buyers_without_sellers", """WITH b AS (SELECT token, count(DISTINCT src) AS buyers FROM transfers WHERE tx_type = 'N' GROUP BY 1), s AS (SELECT token, count(DISTINCT src) AS sellers FROM transfers WHERE tx_type = 'R' GROUP BY 1)
  SELECT b.token, buyers, coalesce(sellers, 0) AS sellers FROM b LEFT JOIN s ON b.token = s.token WHERE buyers >= 10 AND coalesce(sellers, 0) * 2 < buyers""")(lambda t: matching.buyers_without_sellers(t, 10))
query("j24_same_label_targets", """SELECT e.src, sum(CASE WHEN a.n_regionkey = b.n_regionkey THEN 1 ELSE 0 END)::BIGINT AS alike, count(*) AS n FROM nation_flow e JOIN nation a ON e.src = a.n_nationkey JOIN nation b ON e.dst = b.n_nationkey GROUP BY 1""")(
    lambda s, d: graph.neighbours_alike(N(s, d), table(s, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("label")))
)
on(T, "j27_shared_tokens", """WITH o AS (SELECT DISTINCT src AS wallet, token FROM transfers), n AS (SELECT wallet, count(*) AS n FROM o GROUP BY 1),
  c AS (SELECT a.wallet AS wallet1, b.wallet AS wallet2, count(*) AS common FROM o a JOIN o b ON a.token = b.token AND a.wallet < b.wallet GROUP BY 1, 2 HAVING count(*) >= 3)
  SELECT wallet1, wallet2, common, round(common / greatest(x.n, y.n), 6) AS overlap, round(common / (x.n + y.n - common), 6) AS jaccard FROM c JOIN n x ON wallet1 = x.wallet JOIN n y ON wallet2 = y.wallet""")(
    lambda t: matching.overlapping_holders(t.select(F.col("src").alias("wallet"), "token"), 3)
)
on(T, "w12_latest_transfer", "SELECT src, tx_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ts DESC, tx_id) AS r FROM transfers) WHERE r = 1")(
    lambda t: matching.latest(t, "src", [F.desc("ts"), F.col("tx_id")]).select("src", "tx_id", "ts")
)
on(T, "t11_large_transfers", "SELECT tx_id, src, dst, round(value, 4) AS value FROM transfers WHERE chain = 'ASIA' AND value >= 50000 ORDER BY transfers.value DESC, tx_id LIMIT 10")(
    lambda t: t.filter("chain = 'ASIA' AND value >= 50000").orderBy(F.desc("value"), "tx_id").limit(10).select("tx_id", "src", "dst", F.round("value", 4).alias("value"))
)

# Windows and statistics

on(P, "w01_moving_deviation", """SELECT token, day, round((price - m) / d, 4) AS z FROM (SELECT *, avg(price) OVER w AS m, stddev_pop(price) OVER w AS d, count(price) OVER w AS n FROM price_series WINDOW w AS (PARTITION BY token ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
  WHERE n = 20 AND d > 1e-9 AND abs((price - m) / d) > 3""")(lambda s: series.moving_deviation(s, "token", ["day"], "price", 20, 3))
on(P, "w02_changes", "SELECT token, day, round(100 * (price - lag(price) OVER w) / lag(price) OVER w, 4) AS change_pct FROM price_series WINDOW w AS (PARTITION BY token ORDER BY day)")(lambda s: series.changes(s, "token", "day", "price"))
on(P, "w05_pumps", """WITH b AS (SELECT *, count(*) OVER w AS n, 100 * (price / avg(price) OVER w - 1) AS p, 100 * (volume / avg(volume) OVER w - 1) AS v, row_number() OVER (PARTITION BY token ORDER BY day) AS i FROM price_series WINDOW w AS (PARTITION BY token ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
  h AS (SELECT * FROM b WHERE n = 5 AND p > 20 AND v > 50)
  SELECT token, day, round(p, 4) AS price_pct, round(v, 4) AS volume_pct, (SELECT min(x.day) FROM b x WHERE x.token = h.token AND x.i > h.i AND x.i <= h.i + 48 AND (h.price - x.price) / h.price * 100 > 15) AS dump_day, round((p + v) / 2, 4) AS score FROM h""")(
    lambda s: series.pumps(s, 5, 20, 50, 15)
)
on(P, "w06_pool_withdrawals", "SELECT token, day, volume, round(prior, 2) AS prior FROM (SELECT *, sum(volume) OVER (PARTITION BY token ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM price_series) WHERE volume > 0.5 * prior")(
    lambda s: series.withdrawals_of_pool(s, 0.5)
)
on(source("events"), "w07_chain_hopping", """SELECT user_id, count(DISTINCT event_type) AS chains, coalesce(sum(CASE WHEN b <> event_type THEN 1 ELSE 0 END), 0)::BIGINT AS changes FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) GROUP BY 1
  HAVING count(DISTINCT event_type) >= 3 AND sum(CASE WHEN b <> event_type THEN 1 ELSE 0 END) >= 2""")(lambda e: series.chain_hopping(e, "user_id", "ts", "event_id", "event_type", 3, 2))
on(source("events"), "w09_sessions", """WITH m AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 3600000000 THEN 0 ELSE 1 END AS s FROM events),
  g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM m)
  SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM g GROUP BY user_id, k""")(lambda e: series.sessions(e, "user_id", "ts", "event_id", 3600))
on(source("events"), "w11_recency", """WITH g AS (SELECT user_id, max(epoch_us(ts)) AS t FROM events GROUP BY 1) SELECT user_id, round((t - min(t) OVER ()) / greatest(max(t) OVER () - min(t) OVER (), 1000000), 6) AS recency FROM g""")(lambda e: series.recency(e, "user_id", "ts"))
on(T, "m01_m03_zscores", """WITH g AS (SELECT chain, avg(value) AS m, stddev_pop(value) AS d, count(*) AS n FROM transfers GROUP BY 1), z AS (SELECT tx_id, transfers.chain, abs(value - m) / d AS z FROM transfers JOIN g ON transfers.chain = g.chain WHERE n >= 100 AND d > 0)
  SELECT tx_id, chain, round(z, 4) AS z, CASE WHEN z > 4.5 THEN 'CRITICAL' WHEN z > 3 THEN 'HIGH' WHEN z > 2.25 THEN 'MEDIUM' ELSE 'LOW' END AS severity, round(least(0.95, 0.5 + z / 6 * 0.5), 4) AS confidence FROM z WHERE z > 1.5""")(lambda t: series.zscores(t, "chain", "tx_id", "value", 1.5, 100))
on(P, "m02_iqr_outliers", """WITH g AS (SELECT token, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM price_series GROUP BY 1),
  r AS (SELECT p.token, p.day, CASE WHEN price > q3 THEN price - q3 ELSE q1 - price END / (q3 - q1) AS off FROM price_series p JOIN g ON p.token = g.token WHERE q3 > q1) SELECT day, token, round(off, 4) AS score FROM r WHERE off > 1.5""")(lambda s: series.iqr_outliers(s, "token", "day", "price"))
on(P, "m05_threshold_outliers", "WITH g AS (SELECT token, avg(price) AS m, stddev_samp(price) AS d FROM price_series GROUP BY 1) SELECT p.day, p.token FROM price_series p JOIN g ON p.token = g.token WHERE abs(price - m) > 3 * d")(lambda s: series.threshold_outliers(s, "token", "day", "price"))
on(P, "m05_quantile_outliers", "WITH g AS (SELECT token, quantile_cont(price, 0.05) AS lo, quantile_cont(price, 0.95) AS hi FROM price_series GROUP BY 1) SELECT p.day, p.token FROM price_series p JOIN g ON p.token = g.token WHERE price < lo OR price > hi")(lambda s: series.quantile_outliers(s, "token", "day", "price"))
on(P, "a40_growth", """WITH w AS (SELECT *, 100 * (price / lag(price) OVER (PARTITION BY token ORDER BY day) - 1) AS pct FROM price_series),
  g AS (SELECT token, arg_min(price, day) AS f, arg_max(price, day) AS l, stddev_pop(pct) AS v FROM w GROUP BY 1) SELECT token, round(f, 6) AS first, round(l, 6) AS last, round(l - f, 6) AS change, round(100 * (l / f - 1), 6) AS change_pct, round(v, 6) AS volatility FROM g""")(series.growth)
on(source("events"), "st14_rate_peaks", """SELECT user_id, max(n) AS peak FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n FROM events) GROUP BY 1""")(lambda e: series.rate_peaks(e, "user_id", "ts", "event_id", 3600))

# Graphs

on(T, "g01_build", "SELECT src, dst, count(*) AS n, round(sum(value), 4) AS value, min(ts) AS first_ts FROM transfers WHERE src <> dst AND transfers.value >= 1000 GROUP BY 1, 2")(lambda t: graph.build(t, 1000))
on(T, "g12_degrees", "SELECT node, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out, count(*) AS degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM transfers UNION ALL SELECT dst, 1, 0 FROM transfers) GROUP BY 1")(graph.degrees)
query("g02_reach", """WITH RECURSIVE r(node, hop) AS (SELECT 0, 0 UNION SELECT e.dst, r.hop + 1 FROM r JOIN nation_flow e ON r.node = e.src WHERE r.hop < 3) SELECT node, min(hop) AS hop FROM r GROUP BY 1""")(
    lambda s, d: graph.reach(N(s, d), s.createDataFrame([(0,)], "node int"), 3)
)
S = views.strong_flow
A = views.pair_flow
on(S, "g05_paths", """WITH RECURSIVE p(start_, end_, nodes, n) AS (SELECT src, dst, [src, dst], 1 FROM strong_flow UNION ALL SELECT p.start_, e.dst, list_append(p.nodes, e.dst), p.n + 1 FROM p JOIN strong_flow e ON p.end_ = e.src WHERE p.n < 4 AND NOT list_contains(p.nodes, e.dst))
  SELECT start_ AS start, end_ AS "end", array_to_string(nodes, '>') AS path, n AS length FROM p WHERE n >= 2""")(lambda e: graph.simple_paths(e, 2, 4).select("start", "end", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("path"), "length"))
on(S, "g07_cycles", """WITH RECURSIVE p(start_, end_, nodes, vals, n) AS (SELECT src, dst, [src, dst], [value], 1 FROM strong_flow WHERE src < dst UNION ALL SELECT p.start_, e.dst, list_append(p.nodes, e.dst), list_append(p.vals, e.value), p.n + 1 FROM p JOIN strong_flow e ON p.end_ = e.src WHERE p.n < 5 AND p.end_ <> p.start_ AND (e.dst = p.start_ OR (e.dst > p.start_ AND NOT list_contains(p.nodes, e.dst))))
  SELECT array_to_string(nodes[1:n], '>') AS path, n AS length, round(list_sum(vals), 2) AS total, list_stddev_pop(vals) / list_avg(vals) < 0.2 AS balanced FROM p WHERE end_ = start_ AND n >= 2""")(
    lambda e: graph.cycles(e, 2, 5).select(F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("path"), "length", "total", "balanced")
)
on(U, "g10_peel_chains", """WITH RECURSIVE p(start_, end_, nodes, last, last_ts, n) AS (SELECT src, dst, [src, dst], value, ts, 2 FROM user_flow WHERE src <> dst AND value >= 50
    UNION ALL SELECT p.start_, e.dst, list_append(p.nodes, e.dst), e.value, e.ts, p.n + 1 FROM p JOIN user_flow e ON p.end_ = e.src AND e.src <> e.dst AND e.value <= 0.7 * p.last AND e.ts > p.last_ts AND epoch_us(e.ts) - epoch_us(p.last_ts) <= 7200000000 WHERE p.n < 10 AND NOT list_contains(p.nodes, e.dst))
  SELECT start_ AS start, end_ AS "end", array_to_string(nodes, '>') AS path, round(least(0.95, 0.5 + 0.1 * (n - 4)), 2) AS confidence, CAST(least(100, 50 + 10 * (n - 4)) AS BIGINT) AS risk FROM p WHERE n >= 4""")(
    lambda t: graph.decaying_paths(t.filter("src <> dst"), 0.7, 4, 10, 7200, 50.0).select("start", "end", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("path"), "confidence", "risk")
)
on(U, "g11_hubs", """WITH i AS (SELECT dst AS node, count(*) AS n_in, sum(value) AS vi, epoch_us(min(ts)) AS i0, epoch_us(max(ts)) AS i1 FROM user_flow GROUP BY 1), o AS (SELECT src AS node, count(*) AS n_out, sum(value) AS vo, epoch_us(min(ts)) AS o0, epoch_us(max(ts)) AS o1 FROM user_flow GROUP BY 1),
  b AS (SELECT i.node, n_in, n_out, least(vi, vo) / greatest(vi, vo) AS r, CASE WHEN i1 <= o0 THEN 0.9 ELSE 0.7 * (1 - greatest(0, least(i1, o1) - greatest(i0, o0)) / (greatest(i1, o1) - least(i0, o0))) END AS c FROM i JOIN o ON i.node = o.node WHERE n_in >= 2 AND n_out >= 2)
  SELECT node, n_in, n_out, round(r, 6) AS ratio, round(c, 6) AS confidence, round(least(100, 50 + 30 * c + 20 * r), 2) AS risk FROM b WHERE c >= 0.0001 AND r >= 0.7""")(lambda t: graph.hubs(t, ratio=0.7, sure=0.0001))
_RANKS = ", ".join(f"i{k} AS MATERIALIZED (SELECT coalesce(sum(rank), 0) AS idle FROM r{k} WHERE node NOT IN (SELECT src FROM k)), r{k + 1} AS MATERIALIZED (SELECT nodes.node, 0.15 / n + 0.85 * (coalesce(got, 0) + idle / n) AS rank FROM nodes LEFT JOIN (SELECT dst, sum(rank / k) AS got FROM pair_flow e JOIN k ON e.src = k.src JOIN r{k} ON r{k}.node = e.src GROUP BY 1) g ON nodes.node = g.dst, c, i{k})" for k in range(40))
on(A, "g13_pagerank", f"""WITH nodes AS MATERIALIZED (SELECT src AS node FROM pair_flow UNION SELECT dst FROM pair_flow), k AS MATERIALIZED (SELECT src, count(*) AS k FROM pair_flow GROUP BY 1), c AS (SELECT count(*) AS n FROM nodes), r0 AS MATERIALIZED (SELECT node, 1.0 / n AS rank FROM nodes, c), {_RANKS} SELECT node, round(rank, 6) AS rank FROM r40""")(
    lambda e: graph.pagerank(e, tolerance=1e-10).select("node", F.round("rank", 6).alias("rank"))
)
query("g15_risk_spread", """WITH nodes AS (SELECT src AS node FROM nation_flow UNION SELECT dst FROM nation_flow), k AS (SELECT src, count(*) AS k FROM nation_flow GROUP BY 1), s AS (SELECT node, CASE WHEN node IN (1, 5) THEN 1.0 ELSE 0.0 END AS seed FROM nodes),
  a AS (SELECT s.node, 0.5 * seed + 0.5 * coalesce((SELECT sum(x.seed / k.k) FROM nation_flow e JOIN k ON e.src = k.src JOIN s x ON x.node = e.src WHERE e.dst = s.node), 0) AS risk FROM s),
  b AS (SELECT s.node, 0.5 * seed + 0.5 * coalesce((SELECT sum(x.risk / k.k) FROM nation_flow e JOIN k ON e.src = k.src JOIN a x ON x.node = e.src WHERE e.dst = s.node), 0) AS risk FROM s)
  SELECT s.node, round(0.5 * seed + 0.5 * coalesce((SELECT sum(x.risk / k.k) FROM nation_flow e JOIN k ON e.src = k.src JOIN b x ON x.node = e.src WHERE e.dst = s.node), 0), 8) AS risk FROM s""")(
    lambda s, d: graph.risk_spread(N(s, d), s.createDataFrame([(1, 1.0), (5, 1.0)], "node int, risk double")).select("node", F.round("risk", 8).alias("risk"))
)
on(N, "g19_triangles", """WITH u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM nation_flow), t AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b),
  c AS (SELECT node, count(*) AS triangles FROM (SELECT p AS node FROM t UNION ALL SELECT q FROM t UNION ALL SELECT r FROM t) GROUP BY 1), d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM u UNION ALL SELECT b FROM u) GROUP BY 1)
  SELECT d.node, degree, coalesce(triangles, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2.0 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0.0 END, 6) AS clustering FROM d LEFT JOIN c ON d.node = c.node""")(graph.triangles)
on(A, "g22_components", """WITH RECURSIVE b AS (SELECT src, dst FROM pair_flow UNION SELECT dst, src FROM pair_flow), r(node, c) AS (SELECT src, src FROM b UNION SELECT b.dst, r.c FROM r JOIN b ON r.node = b.src) SELECT node, min(c) AS component FROM r GROUP BY 1""")(lambda e: graph.components(e))
query("a47_label_pairs", """SELECT a.r_name AS from_label, b.r_name AS to_label, count(*) AS n FROM nation_flow e JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) a ON e.src = a.n_nationkey
  JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) b ON e.dst = b.n_nationkey GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 100""")(
    lambda s, d: graph.label_pairs(N(s, d), table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("node"), F.col("r_name").alias("label")))
)

# Sets and upserts

on(T, "u01_addresses", "SELECT count(DISTINCT a) AS addresses FROM (SELECT src AS a FROM transfers UNION SELECT dst FROM transfers)")(lambda t: t.select(F.explode(F.array("src", "dst")).alias("a")).agg(F.countDistinct("a").alias("addresses")))
_OLD = "SELECT o_custkey AS k, min(o_orderpriority) AS a, min(o_totalprice) AS b FROM orders WHERE o_totalprice > 250000 GROUP BY 1"
_NEW = "SELECT c_custkey AS k, CASE WHEN c_acctbal > 3000 THEN upper(c_name) END AS a, c_acctbal + 1 AS b FROM customer WHERE c_mktsegment <> 'BUILDING'"


def _old_new(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers known by large orders, and new rows of those outside one segment."""
    old = table(s, d, "orders").filter("o_totalprice > 250000").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderpriority").alias("a"), F.min("o_totalprice").alias("b"))
    c = table(s, d, "customer").filter("c_mktsegment <> 'BUILDING'")
    return old, c.select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") > 3000, F.upper("c_name")).alias("a"), (F.col("c_acctbal") + 1).alias("b"))


query("k05_merge", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT k, a, b FROM n UNION ALL SELECT k, a, b FROM o WHERE k NOT IN (SELECT k FROM n)")(lambda s, d: upserts.merge(*_old_new(s, d), ["k"]))
query("k08_create_unique", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT k, a, b FROM o UNION ALL SELECT k, a, b FROM n WHERE k NOT IN (SELECT k FROM o)")(lambda s, d: upserts.create_unique(*_old_new(s, d), ["k"]))
query("k09_merge_partial", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(o.k, n.k) AS k, coalesce(n.a, o.a) AS a, coalesce(n.b, o.b) AS b FROM o FULL JOIN n ON o.k = n.k")(lambda s, d: upserts.merge_partial(*_old_new(s, d), ["k"]))
query("k07_merge_greatest", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(o.k, n.k) AS k, greatest(n.a, o.a) AS a, greatest(n.b, o.b) AS b FROM o FULL JOIN n ON o.k = n.k")(lambda s, d: upserts.merge_greatest(*_old_new(s, d), ["k"]))
query("k10_count_up", "SELECT user_id, CAST(count(*) + CASE WHEN user_id % 2 = 0 THEN 5 ELSE 0 END AS BIGINT) AS approvals FROM events GROUP BY 1")(
    lambda s, d: upserts.count_up(table(s, d, "events").filter("user_id % 2 = 0").select("user_id").distinct().withColumn("approvals", F.lit(5)), table(s, d, "events"), "user_id", "approvals")
)

# Retrieval and evidence

on(source("documents"), "v07_keyword_search", """WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) > 0)) AS t, contains(lower(text), 'the and') AS direct FROM documents),
  s AS (SELECT doc_id, round(CASE WHEN direct THEN 0.9 WHEN len(list_intersect(t, ['the', 'and'])) > 0 THEN 0.5 + 0.4 * len(list_intersect(t, ['the', 'and'])) / 2 END, 6) AS score FROM w)
  SELECT doc_id, score FROM s WHERE score IS NOT NULL ORDER BY score DESC, doc_id LIMIT 20""")(lambda t: retrieval.keyword_search(t, "the and", "doc_id", "text", 20))
on(source("events"), "m14_evidence_quality", """SELECT event_id, round(0.5 + 0.2 * least(1, value / 100) + 0.1 * CASE event_type WHEN 'signup' THEN 0.9 WHEN 'purchase' THEN 0.8 ELSE 0.5 END + 0.2 * (0.4 * 1 + 0.4 * CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END + 0.2), 6) AS quality FROM events""")(
    lambda e: e.select("event_id", evaluation.evidence_quality(F.least(F.lit(1.0), F.col("value") / 100), F.when(F.col("event_type") == "signup", "human").when(F.col("event_type") == "purchase", "external").otherwise("llm"), F.lit(True), F.pmod("user_id", F.lit(2)) == 0, F.lit(True)).alias("quality"))
)
on(source("events"), "a50_a51_confidence", """SELECT event_type, count(*) AS n, round(coalesce(sum(value / 1000 * (user_id % 5)) / nullif(sum(user_id % 5), 0), 0), 6) AS confidence, round(1 - avg(value / 1000), 6) AS uncertainty FROM events GROUP BY 1""")(
    lambda e: evaluation.weighted_confidence(e.select("event_type", (F.col("value") / 1000).alias("confidence"), F.pmod("user_id", F.lit(5)).cast("double").alias("quality")), "event_type")
)

# Declarative patterns

PATTERNS = (
    Pattern("STRUCT_001", "HIGH", ("src",), where={"value": {"$gte": 8000, "$lt": 10000}}, having={"n": ("count", "*", {"$gte": 3}), "total": ("sum", "value", {})}, actions=("ALERT", "SCORE")),
    Pattern("SMURF_001", "HIGH", ("dst",), where={"value": {"$lt": 20000}}, having={"n": ("count", "*", {"$gte": 20}), "total": ("sum", "value", {})}, actions=("ALERT",)),
    Pattern("BURST_001", "MEDIUM", ("src", "chain"), having={"n": ("count", "*", {"$gte": 2}), "total": ("sum", "value", {"$gt": 50000})}, window="P365D", within="P30D", actions=("SCORE",)),
)


@query("g36_patterns", """SELECT 'STRUCT_001' AS pattern, 'HIGH' AS risk, src AS key, count(*) AS n, round(sum(value), 4) AS total, 'ALERT,SCORE' AS actions FROM transfers WHERE value >= 8000 AND value < 10000 GROUP BY src HAVING count(*) >= 3
  UNION ALL SELECT 'SMURF_001', 'HIGH', dst, count(*), round(sum(value), 4), 'ALERT' FROM transfers WHERE value < 20000 GROUP BY dst HAVING count(*) >= 20
  UNION ALL SELECT 'BURST_001', 'MEDIUM', src || '|' || chain, count(*), round(sum(value), 4), 'SCORE' FROM transfers WHERE ts >= (SELECT max(ts) FROM transfers) - INTERVAL 365 DAY GROUP BY src, chain HAVING count(*) >= 2 AND sum(value) > 50000 AND epoch_us(max(ts)) - epoch_us(min(ts)) <= 2592000000000""")
def g36_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T(spark, sf_dir)
    first, *rest = [compile_pattern(p, t) for p in PATTERNS]
    for r in rest:
        first = first.unionByName(r)
    return first


from tracewright import catalog_findings, catalog_flows, catalog_graphs, catalog_learning, catalog_loads, catalog_models, catalog_records, catalog_streams  # noqa: E402, F401  they register their queries
