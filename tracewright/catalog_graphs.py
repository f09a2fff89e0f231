"""Queries of graphs: neighbourhoods, paths, centralities, communities, clusters, features and risks of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright import views
from tracewright.operators import evaluation, graph, risk
from tracewright.registry import on, query
from tracewright.views import table

S, A, U, N, T, G = views.strong_flow, views.pair_flow, views.user_flow, views.nation_flow, views.transfers, views.graph_nodes
_BOTH = "SELECT src, dst FROM strong_flow UNION SELECT dst, src FROM strong_flow"
_ALL = "SELECT src, dst FROM pair_flow UNION SELECT dst, src FROM pair_flow"
_HOPS = "d(start_, node, hops) AS (SELECT DISTINCT src, src, 0 FROM (SELECT src FROM strong_flow UNION SELECT dst FROM strong_flow) UNION SELECT d.start_, e.dst, d.hops + 1 FROM d JOIN strong_flow e ON d.node = e.src WHERE d.hops < 14), m AS (SELECT start_, node, min(hops) AS hops FROM d GROUP BY 1, 2)"


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("community"))


def _ids(spark: SparkSession, *ids: int) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "node long")


query("g03_subgraph", f"WITH RECURSIVE b AS ({_ALL}), r(node, hop) AS (SELECT 1, 0 UNION SELECT b.dst, r.hop + 1 FROM r JOIN b ON r.node = b.src WHERE r.hop < 2) SELECT src, dst, value FROM pair_flow WHERE src IN (SELECT node FROM r) AND dst IN (SELECT node FROM r)")(
    lambda s, d: graph.subgraph(A(s, d), _ids(s, 1), 2).select("src", "dst", "value")
)
query("g04_shortest_paths", f"""WITH RECURSIVE b AS ({_BOTH}), w AS (SELECT DISTINCT src AS start_, 1 AS end_ FROM strong_flow WHERE src <> 1), r(node, hop) AS (SELECT 1, 0 UNION SELECT b.dst, r.hop + 1 FROM r JOIN b ON r.node = b.src WHERE r.hop < 6)
  SELECT start_ AS start, CAST(1 AS BIGINT) AS "end", min(hop) AS length FROM w JOIN r ON r.node = start_ GROUP BY 1""")(
    lambda s, d: graph.shortest_paths(S(s, d), S(s, d).filter("src <> 1").select(F.col("src").alias("start"), F.lit(1).cast("long").alias("end")), 6).select("start", "end", "length")
)
on(U, "g06_rapid_paths", """WITH RECURSIVE p(start_, end_, a, z, chain, n) AS (SELECT src, dst, ts, ts, chain, 1 FROM user_flow UNION ALL SELECT p.start_, e.dst, p.a, e.ts, p.chain, p.n + 1 FROM p JOIN user_flow e ON e.src = p.end_ AND e.chain = p.chain AND e.ts > p.z AND epoch_us(e.ts) - epoch_us(p.a) <= 14400000000 WHERE p.n < 10)
  SELECT start_ AS start, end_ AS "end", n AS length, chain AS token, n >= 3 AND epoch_us(z) - epoch_us(a) <= 3600000000 AS rapid FROM p WHERE n >= 2 AND start_ <> end_""")(
    lambda t: graph.rapid_paths(t.withColumn("token", F.col("chain")), 2, 10, 14_400).select("start", "end", "length", "token", ((F.col("length") >= 3) & (F.col("micros") <= 3_600_000_000)).alias("rapid"))
)
_CYCLES = """p(start_, end_, nodes, vals, n) AS (SELECT src, dst, [src, dst], [value], 1 FROM strong_flow WHERE src < dst UNION ALL SELECT p.start_, e.dst, list_append(p.nodes, e.dst), list_append(p.vals, e.value), p.n + 1 FROM p JOIN strong_flow e ON p.end_ = e.src WHERE p.n < 5 AND p.end_ <> p.start_ AND (e.dst = p.start_ OR (e.dst > p.start_ AND NOT list_contains(p.nodes, e.dst)))),
  c AS (SELECT nodes[1:n] AS nodes, n, list_sum(vals) AS total, list_stddev_pop(vals) / list_avg(vals) < 0.2 AS balanced FROM p WHERE end_ = start_ AND n >= 2)"""
on(U, "g08_flow_cycles", """WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst, epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS z FROM user_flow WHERE value >= 95 AND src <> dst GROUP BY 1, 2),
  p(start_, end_, nodes, a, z, n) AS (SELECT src, dst, [src, dst], a, z, 1 FROM e WHERE src < dst UNION ALL SELECT p.start_, e.dst, list_append(p.nodes, e.dst), least(p.a, e.a), greatest(p.z, e.z), p.n + 1 FROM p JOIN e ON p.end_ = e.src WHERE p.n < 5 AND p.end_ <> p.start_ AND (e.dst = p.start_ OR (e.dst > p.start_ AND NOT list_contains(p.nodes, e.dst)))),
  c AS (SELECT nodes[1:n] AS nodes, n, greatest(0.0, 1 - (z - a) / 3600000000.0 / 24) AS quick, least(1, (n - 2) / 5.0) AS long FROM p WHERE end_ = start_ AND n >= 3)
  SELECT array_to_string(nodes, '>') AS path, n AS length, round(0.5 + 0.25 * quick + 0.25 * long, 6) AS confidence, round(least(100.0, 60 + 20 * quick + 20 * long), 6) AS risk FROM c""")(
    lambda t: graph.circular_flows(graph.cycles(t.filter("value >= 95"), 3, 5)).select(F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("path"), "length", "confidence", "risk")
)
on(S, "g09_cycle_members", f"WITH RECURSIVE {_CYCLES} SELECT node, count(*) AS n FROM (SELECT unnest(nodes) AS node FROM c) GROUP BY 1 HAVING count(*) >= 2")(lambda e: graph.in_cycles(graph.cycles(e, 2, 5)))
on(S, "a64_cycle_summary", f"WITH RECURSIVE {_CYCLES} SELECT count(*) AS cycles, count(CASE WHEN balanced THEN 1 END) AS balanced, round(sum(total), 2) AS total, round(avg(n), 6) AS mean_length FROM c")(
    lambda e: graph.cycles(e, 2, 5).agg(F.count("*").alias("cycles"), F.count_if("balanced").alias("balanced"), F.round(F.sum("total"), 2).alias("total"), F.round(F.avg("length"), 6).alias("mean_length"))
)
on(N, "g14_weighted_ranks", None)(lambda e: graph.pagerank(e, 20, weight="value").select("node", F.round("rank", 6).alias("rank")))
query("g16_risk_write_back", """WITH k AS (SELECT src, count(*) AS k FROM nation_flow GROUP BY 1), s AS (SELECT n_nationkey AS node, CASE WHEN n_nationkey IN (1, 5) THEN 1.0 ELSE 0.0 END AS seed FROM nation), a AS (SELECT s.node, 0.5 * seed + 0.5 * coalesce((SELECT sum(x.seed / k.k) FROM nation_flow e JOIN k ON e.src = k.src JOIN s x ON x.node = e.src WHERE e.dst = s.node), 0) AS risk FROM s)
  SELECT n_nationkey AS node, n_name AS name, round(coalesce(CASE WHEN risk >= 0.4 THEN risk END, 0.0), 6) AS risk FROM nation JOIN a ON node = n_nationkey""")(
    lambda s, d: table(s, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("name")).join(graph.risk_spread(N(s, d), s.createDataFrame([(1, 1.0), (5, 1.0)], "node int, risk double"), 1).filter("risk >= 0.4"), "node", "left").select("node", "name", F.round(F.coalesce("risk", F.lit(0.0)), 6).alias("risk"))
)
on(S, "g17_betweenness", None)(lambda e: graph.betweenness(e).select("node", F.round("betweenness", 8).alias("betweenness")))
on(S, "g18_closeness", f"WITH RECURSIVE {_HOPS}, c AS (SELECT count(DISTINCT node) AS n FROM m) SELECT node, round(coalesce((count(*) - 1) * (count(*) - 1) / nullif(sum(hops) * (any_value(n) - 1), 0), 0.0), 8) AS closeness FROM m, c GROUP BY 1")(
    lambda e: graph.closeness(e).select("node", F.round("closeness", 8).alias("closeness"))
)
on(U, "g17_betweenness_sampled", None)(lambda t: graph.betweenness(t, sources=64))
on(U, "g18_closeness_sketched", None)(graph.closeness_sketched)
on(U, "g21_path_lengths_sketched", None)(graph.path_lengths_sketched)
on(U, "g05_trails", """WITH RECURSIVE s AS MATERIALIZED (SELECT event_id AS id, src AS a, dst AS b FROM user_flow WHERE chain IN ('purchase', 'error') AND value >= 50 UNION ALL SELECT event_id, dst, src FROM user_flow WHERE chain IN ('purchase', 'error') AND value >= 50 AND src <> dst),
  p(start_, end_, edges, n) AS (SELECT a, b, [id], 1 FROM s WHERE a IN (1, 2, 3) UNION ALL SELECT p.start_, s.b, list_append(p.edges, s.id), p.n + 1 FROM p JOIN s ON p.end_ = s.a WHERE p.n < 2 AND NOT list_contains(p.edges, s.id))
  SELECT start_ AS start, end_ AS "end", array_to_string(edges, '>') AS edges, n AS length FROM p""")(
    lambda t: graph.trails(t.filter("value >= 50").withColumn("kind", F.col("chain")), "event_id", 1, 2, "BOTH", ["purchase", "error"], t.sparkSession.createDataFrame([(1,), (2,), (3,)], "node long")).select("start", "end", F.array_join(F.transform("edges", lambda x: x.cast("string")), ">").alias("edges"), "length")
)
on(A, "g20_density", "WITH c AS (SELECT count(DISTINCT x) AS v FROM (SELECT src AS x FROM pair_flow UNION ALL SELECT dst FROM pair_flow)) SELECT v AS nodes, count(*) AS edges, round(count(*) / (v * (v - 1)), 8) AS density, round(2 * count(*) / v, 6) AS mean_degree FROM pair_flow, c GROUP BY v")(risk.density)
on(N, "g21_path_lengths", """WITH RECURSIVE d(start_, node, hops) AS (SELECT DISTINCT src, src, 0 FROM nation_flow UNION SELECT d.start_, e.dst, d.hops + 1 FROM d JOIN nation_flow e ON d.node = e.src WHERE d.hops < 6), m AS (SELECT start_, node, min(hops) AS hops FROM d GROUP BY 1, 2), c AS (SELECT count(DISTINCT src) AS n FROM (SELECT src FROM nation_flow UNION SELECT dst FROM nation_flow))
  SELECT n AS nodes, CASE WHEN count(*) = n * n THEN round(sum(hops) / (n * (n - 1)), 6) END AS mean_length, CASE WHEN count(*) = n * n THEN max(hops) END AS diameter FROM m, c GROUP BY n""")(lambda e: graph.path_lengths(e).withColumn("mean_length", F.round("mean_length", 6)))
on(A, "g23_strong_components", """WITH RECURSIVE v AS (SELECT src AS node FROM pair_flow UNION SELECT dst FROM pair_flow), r(a, b) AS (SELECT node, node FROM v UNION SELECT r.a, e.dst FROM r JOIN pair_flow e ON r.b = e.src) SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1""")(graph.strong_components)
on(S, "g24_louvain", None)(graph.louvain)
query("g24_modularity", """WITH p AS (SELECT e.value AS w, a.n_regionkey AS a, b.n_regionkey AS b FROM nation_flow e JOIN nation a ON e.src = a.n_nationkey JOIN nation b ON e.dst = b.n_nationkey), d AS (SELECT c, sum(w) AS d FROM (SELECT a AS c, w FROM p UNION ALL SELECT b, w FROM p) GROUP BY 1)
  SELECT round((SELECT sum(w) FROM p WHERE a = b) / (SELECT sum(w) FROM p) - (SELECT sum(d * d) FROM d) / (4 * (SELECT sum(w) FROM p) * (SELECT sum(w) FROM p)), 8) AS modularity""")(lambda s, d: graph.modularity(N(s, d), _regions(s, d)).select(F.round("modularity", 8).alias("modularity")))
_VOTES = ", ".join(f"l{k + 1} AS MATERIALIZED (SELECT src AS node, c FROM (SELECT src, c, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, c) AS r FROM b JOIN l{k} ON dst = node GROUP BY src, c) WHERE r = 1)" for k in range(5))
on(A, "g25_label_propagation", f"WITH b AS MATERIALIZED ({_ALL}), l0 AS (SELECT DISTINCT src AS node, src AS c FROM b), {_VOTES} SELECT node, c AS community FROM l5")(lambda e: graph.label_propagation(e, 5))
query("g26_communities", """SELECT a.n_regionkey AS community, count(*) AS n, round(sum(value), 0) AS value FROM nation_flow e JOIN nation a ON e.src = a.n_nationkey JOIN nation b ON e.dst = b.n_nationkey WHERE a.n_regionkey = b.n_regionkey GROUP BY 1""")(
    lambda s, d: graph.inner_edges(N(s, d), _regions(s, d)).withColumn("value", F.round("value", 0))
)
query("g26_sizes", "SELECT n_regionkey AS community, count(*) AS size FROM nation GROUP BY 1 HAVING count(*) >= 2 ORDER BY size DESC, community LIMIT 10")(lambda s, d: graph.community_sizes(_regions(s, d), 2, 10))
on(N, "g26_centralisation", "WITH v AS (SELECT src, sum(n) AS v FROM nation_flow GROUP BY 1) SELECT round((max(v) * count(*) - sum(v)) / ((count(*) - 1) * (count(*) - 1)), 6) AS centralisation FROM v")(
    lambda e: graph.centralisation(e.groupBy("src").agg(F.sum("n").alias("v")), "v").select(F.round("centralisation", 6).alias("centralisation"))
)
on(T, "g27_unusual_share", """WITH d AS (SELECT x, count(*) AS k FROM (SELECT src AS x FROM transfers UNION ALL SELECT dst FROM transfers) GROUP BY 1), s AS (SELECT 0.5 * (SELECT avg(CASE WHEN k > 30 THEN 1.0 ELSE 0.0 END) FROM d) + 0.5 * (SELECT avg(CASE WHEN value > 10000 THEN 1.0 ELSE 0.0 END) FROM transfers) AS v)
  SELECT round(v, 6) AS score, CASE WHEN v > 0.9 THEN 'CRITICAL' WHEN v > 0.78 THEN 'HIGH' WHEN v > 0.66 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM s""")(lambda t: graph.unusual_share(t, 30, 10000))
query("g28_community_outliers", """WITH d AS (SELECT x AS node, count(*) AS degree FROM (SELECT src AS x FROM nation_flow UNION ALL SELECT dst FROM nation_flow) GROUP BY 1), p AS (SELECT d.*, n_regionkey AS c FROM d JOIN nation ON n_nationkey = node), g AS (SELECT c, avg(degree) AS m, stddev_samp(degree) AS s, count(*) AS size FROM p GROUP BY 1),
  b AS (SELECT src, dst FROM nation_flow UNION SELECT dst, src FROM nation_flow), k AS (SELECT b.src AS node, count(*) AS k FROM b JOIN p x ON b.src = x.node JOIN p y ON b.dst = y.node WHERE x.c = y.c GROUP BY 1)
  SELECT p.node, p.c AS community, round(0.7 * coalesce(abs(m - degree) / nullif(s, 0), 0) + 0.3 * coalesce(k, 0) / size, 6) AS score FROM p JOIN g ON p.c = g.c LEFT JOIN k ON k.node = p.node""")(
    lambda s, d: graph.community_outliers(N(s, d), _regions(s, d), 0.0).withColumn("score", F.round("score", 6))
)
query("g29_node_features", """WITH o AS (SELECT src AS id, count(*) AS n_out, count(DISTINCT dst) AS partners, sum(value) AS v FROM transfers GROUP BY 1), r AS (SELECT src AS id, count(*) AS n30 FROM transfers WHERE ts >= (SELECT max(ts) FROM transfers) - INTERVAL 365 DAY GROUP BY 1)
  SELECT n.id, coalesce(n_out, 0) AS n_out, coalesce(partners, 0) AS partners, round(coalesce(v, 0.0), 4) AS volume, coalesce(n30, 0) AS recent FROM graph_nodes n LEFT JOIN o ON n.id = o.id LEFT JOIN r ON n.id = r.id""")(lambda s, d: risk.node_features(T(s, d), G(s, d).select("id"), 365))
query("g30_shared_clusters", """WITH p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n FROM user_flow WHERE src <> dst GROUP BY 1, 2 HAVING count(*) >= 2), f AS (SELECT b AS node FROM p WHERE a = 1 UNION SELECT a FROM p WHERE b = 1) SELECT DISTINCT x AS node FROM (SELECT node AS x FROM f UNION SELECT b FROM p JOIN f ON a = node UNION SELECT a FROM p JOIN f ON b = node)""")(
    lambda s, d: risk.shared_clusters(U(s, d), _ids(s, 1), 2, 2)
)
query("g31_clusters", """WITH RECURSIVE v AS (SELECT user_id AS node, sum(value) AS value, min(ts) AS a, max(ts) AS z FROM events GROUP BY 1), b AS (SELECT src, dst FROM pair_flow UNION SELECT dst, src FROM pair_flow), r(node, c) AS (SELECT node, node FROM v UNION SELECT b.dst, r.c FROM r JOIN b ON r.node = b.src), c AS (SELECT node, min(c) AS component FROM r GROUP BY 1)
  SELECT component, count(*) AS size, round(sum(value), 2) AS value, min(a) AS first_ts, max(z) AS last_ts FROM c JOIN v ON c.node = v.node GROUP BY 1""")(
    lambda s, d: graph.clusters(A(s, d), table(s, d, "events").select(F.col("user_id").alias("node"), "value", F.col("ts").cast("timestamp").alias("ts"))).withColumn("value", F.round("value", 2))
)
query("g32_feature_matrix", """WITH o AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS ordinal FROM (SELECT DISTINCT user_id FROM events)) SELECT o.user_id, ordinal, round(coalesce(sum(CASE WHEN event_type = 'click' THEN value END), 0.0), 4) AS click, round(coalesce(sum(CASE WHEN event_type = 'error' THEN value END), 0.0), 4) AS error FROM o JOIN events e ON e.user_id = o.user_id GROUP BY 1, 2""")(
    lambda s, d: (e := table(s, d, "events")).groupBy("user_id").pivot("event_type", ["click", "error"]).agg(F.round(F.sum("value"), 4)).fillna(0.0, ["click", "error"]).join(graph.ordinals(e, "user_id"), "user_id")
)
query("j30_edge_index", """WITH o AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i FROM (SELECT src AS x FROM pair_flow UNION SELECT dst FROM pair_flow)) SELECT a.i AS src_index, b.i AS dst_index FROM pair_flow JOIN o a ON a.x = src JOIN o b ON b.x = dst""")(
    lambda s, d: risk.edge_index(A(s, d))
)
on(U, "g34_flow_risk", """WITH m AS (SELECT count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0 AS h, count(CASE WHEN value >= 90 THEN 1 END) AS big, count(DISTINCT (src, dst)) AS e FROM user_flow), v AS (SELECT count(*) AS n FROM (SELECT src FROM user_flow UNION SELECT dst FROM user_flow)),
  c AS (SELECT count(*) AS k FROM (SELECT src FROM user_flow GROUP BY 1 HAVING count(DISTINCT chain) > 1)) SELECT round(greatest(0, least(100, 0.5 * 80 + least(25, 5 * big) + CASE WHEN e / (v.n * (v.n - 1)) < 0.1 AND v.n >= 10 THEN 10 ELSE 0 END + CASE WHEN k >= 3 THEN 15 ELSE 0 END + CASE WHEN m.n / h >= 10 THEN 15 ELSE 0 END)), 4) AS risk FROM m, v, c""")(lambda t: risk.flow_risk(t, 80.0, 90.0))
query("g35_cluster_risk", """WITH g AS (SELECT user_id AS cluster, count(DISTINCT event_type) AS chains, sum(value) AS usd, count(*) AS moves, avg(value) / 100 AS conf FROM events GROUP BY 1) SELECT cluster, round(greatest(0, least(100, CASE WHEN chains > 5 THEN 20 WHEN chains > 3 THEN 10 ELSE 0 END + CASE WHEN usd > 1000000 THEN 20 WHEN usd > 100000 THEN 10 ELSE 0 END
    + CASE WHEN moves > 10 THEN 20 WHEN moves > 5 THEN 10 ELSE 0 END + CASE WHEN chains >= 3 THEN 20 ELSE 0 END + 20 * (1 - conf))), 4) AS risk FROM g""")(
    lambda s, d: table(s, d, "events").groupBy(F.col("user_id").alias("cluster")).agg(F.countDistinct("event_type").alias("chains"), F.sum("value").alias("usd"), F.count("*").alias("moves"), (F.avg("value") / 100).alias("conf"))
    .select("cluster", F.round(risk.cluster_risk(F.col("chains"), F.col("usd"), F.col("moves"), F.lit(False), F.col("chains") >= 3, F.lit(False), F.col("conf")), 4).alias("risk"))
)
on(views.transfers, "g37_pattern_risk", """WITH f AS (SELECT src AS entity, 'HIGH' AS s, 0.7 AS c, count(*) AS n FROM transfers WHERE value >= 8000 AND value < 10000 GROUP BY 1 UNION ALL SELECT src, 'MEDIUM', 0.5, count(*) FROM transfers WHERE value > 60000 GROUP BY 1) SELECT entity, round(least(0.95, avg(CASE s WHEN 'HIGH' THEN 0.8 ELSE 0.5 END * c * least(n, 5) / 5)), 6) AS risk, count(*) AS kinds FROM f GROUP BY 1""")(
    lambda t: evaluation.pattern_risk(
        t.filter("value >= 8000 AND value < 10000").groupBy(F.col("src").alias("entity")).agg(F.count("*").alias("n")).select("entity", F.lit("HIGH").alias("severity"), F.lit(0.7).alias("confidence"), "n")
        .unionByName(t.filter("value > 60000").groupBy(F.col("src").alias("entity")).agg(F.count("*").alias("n")).select("entity", F.lit("MEDIUM").alias("severity"), F.lit(0.5).alias("confidence"), "n"))
    )
)
query("g43_identities", """WITH RECURSIVE b AS (SELECT src, dst FROM pair_flow UNION SELECT dst, src FROM pair_flow), r(node, c) AS (SELECT src, src FROM b UNION SELECT b.dst, r.c FROM r JOIN b ON r.node = b.src), k AS (SELECT node, min(c) AS component FROM r GROUP BY 1)
  SELECT component, count(DISTINCT node) AS wallets, count(*) AS moves, count(DISTINCT chain) AS chains, round(sum(value), 2) AS value FROM k JOIN user_flow ON src = node GROUP BY 1""")(
    lambda s, d: graph.components(A(s, d)).join(U(s, d).select(F.col("src").alias("node"), "chain", "value"), "node").groupBy("component").agg(F.countDistinct("node").alias("wallets"), F.count("*").alias("moves"), F.countDistinct("chain").alias("chains"), F.round(F.sum("value"), 2).alias("value"))
)
query("g45_element", "SELECT 'node' AS kind, id AS a, label AS b FROM graph_nodes WHERE id = 'C1' UNION ALL SELECT 'edge', src, dst FROM transfers WHERE src = 'C1'")(
    lambda s, d: G(s, d).filter("id = 'C1'").select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("b")).unionByName(T(s, d).filter("src = 'C1'").select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")))
)
query("a67_subgraph_types", "WITH n AS (SELECT label, count(*) AS n FROM graph_nodes WHERE chain = 'ASIA' GROUP BY 1), e AS (SELECT count(*) AS e FROM transfers WHERE chain = 'ASIA') SELECT label, n, (SELECT sum(n) FROM n) > 3 AND e > 3 AS circular FROM n, e")(
    lambda s, d: risk.subgraph_types(G(s, d).filter("chain = 'ASIA'"), T(s, d).filter("chain = 'ASIA'"))
)
