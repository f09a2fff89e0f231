"""Queries of patterns, evidence, retrieval, streams, features and scalar functions."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright import views
from tracewright.functions import scalars as X
from tracewright.operators import chunking, findings, retrieval, series
from tracewright.operators.quantiles import quantiles
from tracewright.lineage import written
from tracewright.plans import catalogue, patterns
from tracewright.registry import on, query, source
from tracewright.streaming import flows
from tracewright.views import table

E, U, P, G = source("events"), views.user_flow, views.price_series, views.graph_nodes


def demonstration() -> list[catalogue.Specification]:
    return catalogue.read_catalogue([(Path(catalogue.__file__).parent / "demonstration.yaml").read_text(encoding="utf-8")])


def _pattern(name: str, s: SparkSession, d: str) -> DataFrame:
    spec = next(p for p in demonstration() if p.id == name)
    edges = U(s, d).select(F.col("event_id").alias("edge_id"), "src", "dst", F.col("chain").alias("type"), "value", "ts")
    nodes = table(s, d, "events").select(F.col("user_id").alias("id"), F.lit("User").alias("label")).distinct()
    return catalogue.compile_specification(spec, nodes, edges)


_LAYER = """WITH RECURSIVE p(a, z, v0, v1, t0, t1, n) AS (SELECT src, dst, value, value, ts, ts, 1 FROM user_flow UNION ALL SELECT p.a, e.dst, p.v0, e.value, p.t0, e.ts, p.n + 1 FROM p JOIN user_flow e ON e.src = p.z AND e.ts > p.t1 AND epoch_us(e.ts) - epoch_us(p.t0) <= 7200000000 WHERE p.n < 4)
  SELECT 'LAYER_001' AS pattern, 'HIGH' AS risk, a AS a_id, z AS z_id, n AS p_length, v0 AS p_first, v1 AS p_last, t0 AS p_from, t1 AS p_to FROM p WHERE n >= 3 AND v1 >= 0.9 * v0"""
_MIXER = """SELECT 'MIXER_001' AS pattern, 'MEDIUM' AS risk, x.src AS a_id, x.dst AS m_id, count(*) AS n FROM user_flow x JOIN user_flow y ON x.dst = y.src AND x.event_id <> y.event_id WHERE x.dst IN (3, 5) AND y.value >= 50 AND x.ts < y.ts GROUP BY x.src, x.dst
  HAVING count(*) >= 2 AND (epoch_us(max(y.ts)) - epoch_us(min(y.ts))) / 1000000.0 <= 25 * 86400"""
_STRUCT = """SELECT 'STRUCT_001' AS pattern, 'HIGH' AS risk, src AS e_src, count(*) AS n, round(sum(value), 4) AS total FROM transfers WHERE value >= 8000 AND value < 10000 AND epoch_us(ts) >= (SELECT max(epoch_us(ts)) FROM transfers) - 1500 * 86400000000 GROUP BY src HAVING count(*) >= 2"""
query("g36_layering_spec", _LAYER)(lambda s, d: _pattern("LAYER_001", s, d))
query("g36_mixer_spec", _MIXER)(lambda s, d: _pattern("MIXER_001", s, d))


@query("g36_structuring_spec", _STRUCT)
def g36_structuring_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.transfers(spark, sf_dir).select(F.col("tx_id").alias("edge_id"), "src", "dst", F.col("tx_type").alias("type"), "value", "ts")
    spec = next(p for p in demonstration() if p.id == "STRUCT_001")
    return catalogue.compile_specification(spec, G(spark, sf_dir).select("id", "label"), t).withColumn("total", F.round("total", 4))


def _matches(s: SparkSession, d: str) -> DataFrame:
    """(id, n): how often each pattern of the catalogue is found, those without a match too."""
    found = [_pattern("LAYER_001", s, d), _pattern("MIXER_001", s, d), g36_structuring_spec(s, d)]
    counts = [f.groupBy(F.col("pattern").alias("_p")).agg(F.count("*").alias("n")) for f in found]
    known = catalogue.catalogue_table(s, demonstration())
    return known.join(counts[0].unionByName(counts[1]).unionByName(counts[2]), F.col("id") == F.col("_p"), "left").drop("_p").fillna(0, ["n"])


_FOUND = f"(VALUES ('STRUCT_001', 'STRUCTURING', 'HIGH', (SELECT count(*) FROM ({_STRUCT}))), ('LAYER_001', 'LAYERING', 'HIGH', (SELECT count(*) FROM ({_LAYER}))), ('MIXER_001', 'MIXING', 'MEDIUM', (SELECT count(*) FROM ({_MIXER})))) AS v(id, category, risk, n)"
query("s17_pattern_catalogue", f"SELECT * FROM {_FOUND}")(lambda s, d: _matches(s, d).select("id", "category", "risk", "n"))
query("f22_pattern_search", f"SELECT id, n FROM {_FOUND} WHERE id = 'LAYER_001'")(lambda s, d: catalogue.search(_matches(s, d), risk="HIGH", tags=("chain", "none"), regulations=("SAR",)).select("id", "n"))


# Evidence: events as items

_ITEMS = "SELECT event_id AS id, event_type AS category, CASE WHEN user_id % 2 = 0 THEN 'api' ELSE 'human' END AS source, value / 100 AS confidence, ['k' || (user_id % 3), event_type] AS tags FROM events"


def _items(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("category"), F.when(F.pmod("user_id", F.lit(2)) == 0, "api").otherwise("human").alias("source"), (F.col("value") / 100).alias("confidence"), F.array(F.concat(F.lit("k"), F.pmod("user_id", F.lit(3)).cast("string")), F.col("event_type")).alias("tags"))


on(_items, "f21_evidence_filter", f"SELECT id FROM ({_ITEMS}) WHERE category IN ('error', 'click') AND source = 'human' AND confidence >= 0.3 AND list_has_any(tags, ['k1', 'none'])")(lambda i: findings.evidence(i, ["error", "click"], ["human"], 0.3, ["k1", "none"]).select("id"))
query("f23_history_search", "SELECT page_id FROM pages WHERE contains(lower(url), 'org') OR contains(lower(html), 'cookie') ORDER BY page_id DESC LIMIT 20")(lambda s, d: findings.text_search(table(s, d, "pages"), "ORG", ["url"]).union(findings.text_search(table(s, d, "pages"), "cookie", ["html"])).select("page_id").distinct().orderBy(F.desc("page_id")).limit(20))
on(_items, "f24_evidence_search", f"SELECT id FROM ({_ITEMS}) WHERE contains(category, 'sign') OR len(list_filter(tags, lambda t: contains(t, 'sign'))) > 0")(lambda i: findings.text_search(i, "SIGN", ["category"], "tags").select("id"))
query("f27_tags", "SELECT vec_id FROM embeddings WHERE label IN (1, 3)")(lambda s, d: table(s, d, "embeddings").filter(F.col("label").isin(1, 3)).select("vec_id"))
query("f31_m16_strategies", "SELECT st AS strategy, event_id AS id FROM events JOIN (VALUES ('large', 'purchase'), ('large', 'signup'), ('round', 'click')) AS v(st, kind) ON event_type = kind")(
    lambda s, d: findings.dispatched(table(s, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind")), s.createDataFrame([("large", ["purchase", "signup"], True), ("round", ["click"], True), ("wash", ["view"], False)], "strategy string, kinds array<string>, enabled boolean"))
)
on(_items, "a49_evidence_summary", f"SELECT category, source, count(*) AS n, round(avg(confidence), 6) AS confidence FROM ({_ITEMS}) GROUP BY GROUPING SETS ((category), (source), ())")(findings.summary)
on(E, "m17_alert_lifecycle", "SELECT user_id, arg_max(status, (ts, event_id)) AS status, count(CASE WHEN b <> status THEN 1 END) AS changes FROM (SELECT *, event_type AS status, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) GROUP BY 1")(lambda e: findings.alert_lifecycle(e.withColumnRenamed("event_type", "status"), "user_id", ["ts", "event_id"]))
query("m18_feature_vector", "WITH g AS (SELECT user_id AS id, sum(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1), p AS (SELECT user_id AS id, max(value) AS w FROM events GROUP BY 1) SELECT p.id, round(coalesce(v, w, 0.0), 4) AS amount FROM p LEFT JOIN g ON g.id = p.id")(
    lambda s, d: table(s, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.round(F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), F.max("value"), F.lit(0.0)), 4).alias("amount"))
)
on(E, "p06_standardised", """WITH v AS (SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type END AS kind, CASE WHEN value >= 1 THEN value END AS value FROM events), f AS (SELECT event_id, kind, coalesce(value, (SELECT median(value) FROM v)) AS value FROM v)
  SELECT event_id, round((value - (SELECT avg(value) FROM f)) / (SELECT stddev_pop(value) FROM f), 6) AS value, coalesce(kind, 'missing') AS kind FROM f""")(
    lambda e: findings.standardised(e.select("event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"), F.when(F.col("value") >= 1, F.col("value")).alias("value")), "event_id", ["value"], "kind")
)
on(P, "w03_w04_baselines", """SELECT token, day, round(p, 4) AS price_pct, round(v, 4) AS volume_pct, p > 20 AND v > 50 AS pump FROM (SELECT *, count(*) OVER w AS n, 100 * (price / avg(price) OVER w - 1) AS p, 100 * (volume / avg(volume) OVER w - 1) AS v FROM price_series WINDOW w AS (PARTITION BY token ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE n = 5""")(
    lambda s: series.baselines(s, 5, 20, 50)
)
query("m06_a52_clusters", None)(lambda s, d: findings.cluster_statistics(findings.clustered((e := table(s, d, "events")).groupBy("user_id").agg(F.sum("value").alias("total"), F.count("*").cast("double").alias("n")), ["total", "n"], 3), ["total", "n"], "user_id"))
query("t08_t09_split", None)(lambda s, d: findings.split_by_hash(table(s, d, "labels").select("doc_id", "quality"), "doc_id", {"train": 0.8, "validate": 0.1, "test": 0.1}))
query("t10_oversampled", None)(lambda s, d: findings.oversampled(table(s, d, "labels").join(table(s, d, "documents"), "doc_id").select("doc_id", "quality", "n_chars"), "quality", ["n_chars"], "doc_id"))
on(E, "m05_deviating_rows", """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1) SELECT event_id FROM events e JOIN q ON e.event_type = q.event_type WHERE value > b + 0.4 * (b - a) OR value < a - 0.4 * (b - a)""")(
    lambda e: e.join(quantiles(e, "event_type", "value", {"a": 0.25, "b": 0.75}), "event_type").filter("value > b + 0.4 * (b - a) OR value < a - 0.4 * (b - a)").select("event_id")
)

# Scalar functions

on(E, "x01_x02_x09_texts", """SELECT event_id, upper(substr(event_type, 1, 3)) AS head, replace(event_type, 'i', '_') AS replaced, regexp_replace(props, '[^0-9]', '', 'g') AS digits, len(regexp_extract_all(props, '\\w+')) AS words, md5(props) AS digest FROM events""")(
    lambda e: e.select("event_id", F.upper(F.substring("event_type", 1, 3)).alias("head"), F.replace("event_type", F.lit("i"), F.lit("_")).alias("replaced"), F.regexp_replace("props", "[^0-9]", "").alias("digits"), F.size(F.regexp_extract_all("props", F.lit(r"\w+"), F.lit(0))).alias("words"), F.md5("props").alias("digest"))
)
on(source("customer"), "x03_similarity", "SELECT c_custkey, round(1 - levenshtein(c_name, c_mktsegment) / greatest(length(c_name), length(c_mktsegment)), 6) AS similarity FROM customer")(lambda c: c.select("c_custkey", F.round(X.text_similarity("c_name", "c_mktsegment"), 6).alias("similarity")))
on(source("documents"), "x05_overlap", r"SELECT doc_id, round(len(list_intersect(['the', 'and', 'of'], list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) > 0)))) / 3, 6) AS overlap FROM documents WHERE text IS NOT NULL")(
    lambda t: t.filter("text IS NOT NULL").select("doc_id", F.round(F.size(F.array_intersect(F.array(*map(F.lit, ("the", "and", "of"))), retrieval.terms(F.col("text")))) / 3, 6).alias("overlap"))
)
on(E, "x06_times", "SELECT event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS epoch, strftime(ts, '%H') AS hour, CAST(floor(epoch_us(ts) / 300000000) AS BIGINT) AS bucket, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS days FROM events")(
    lambda e: e.select("event_id", F.floor(X.micros(F.col("ts")) / 1_000_000).alias("epoch"), F.date_format("ts", "HH").alias("hour"), F.floor(X.micros(F.col("ts")) / 300_000_000).alias("bucket"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("days"))
)
on(E, "x07_numbers", "SELECT event_id, round(sqrt(value), 6) AS root, round(ln(1 + value), 6) AS log_value, greatest(value, 50) AS high, least(value, 50) AS low, abs(value - 50) % 7 AS rest FROM events")(
    lambda e: e.select("event_id", F.round(F.sqrt("value"), 6).alias("root"), F.round(F.log1p("value"), 6).alias("log_value"), F.greatest("value", F.lit(50.0)).alias("high"), F.least("value", F.lit(50.0)).alias("low"), (F.abs(F.col("value") - 50) % 7).alias("rest"))
)
query("x08_x13_vectors", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT vec_id, round(list_sum(e), 5) AS total, round(e[-1], 6) AS last, round(list_max(e), 6) AS high, len(list_filter(e, lambda x: x > 0)) = len(e) AS positive, round(e[1] / sqrt(list_dot_product(e, e)), 5) AS unit FROM v""")(
    lambda s, d: X.vector_facts(table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e")))
)
on(E, "x10_json", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_array_length('[1,2,3]') AS n FROM events""")(lambda e: e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.json_array_length(F.lit("[1,2,3]")).cast("long").alias("n")))
on(E, "x11_conversions", "SELECT event_id, lower(hex(event_id)) AS hexed, event_id / 100.0 AS scaled FROM events".replace("lower(hex(event_id))", "printf('%x', event_id)"))(lambda e: e.select("event_id", F.lower(F.hex("event_id")).alias("hexed"), (F.col("event_id") / 100.0).alias("scaled")))

# Retrieval

_SYN = [("the", "article"), ("the", "determiner"), ("and", "conjunction"), ("bank", "lender")]
query("v02_expansion", r"""WITH l AS (SELECT item_id AS qid, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) > 0) AS ws FROM benchmark), w AS (SELECT qid, word, min(place) AS place FROM (SELECT qid, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM l) GROUP BY 1, 2),
  e AS (SELECT qid, word AS term, place, 0 AS kind FROM w UNION ALL SELECT qid, synonym, place, 1 FROM w JOIN (VALUES ('the', 'article'), ('the', 'determiner'), ('and', 'conjunction'), ('bank', 'lender')) v(word, synonym) ON v.word = w.word),
  t AS (SELECT qid, term, min((place, kind)) AS pos FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos, term) AS k FROM t) SELECT qid, string_agg(term, ' OR ' ORDER BY k) AS expansion FROM r WHERE k <= 20 GROUP BY 1""")(
    lambda s, d: retrieval.expanded(table(s, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query")), s.createDataFrame(_SYN, "word string, synonym string"))
)
query("v03_hybrid_rerank", "SELECT doc_id, round(least(1.0, (0.7 * least(1.0, n_chars / 20011.0) + 0.3 * CASE WHEN lang = 'en' THEN 1.0 ELSE 0.5 END) * CASE lang WHEN 'de' THEN 1.2 WHEN 'fr' THEN 1.1 ELSE 1.0 END), 6) AS score FROM documents WHERE n_chars IS NOT NULL")(
    lambda s, d: retrieval.rerank_hybrid(table(s, d, "documents").filter("n_chars IS NOT NULL").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 20011.0).alias("similarity"), F.when(F.col("lang") == "en", 1.0).otherwise(0.5).alias("overlap"), F.when(F.col("lang") == "de", "subgraph").when(F.col("lang") == "fr", "path").otherwise("node").alias("kind"))).select("doc_id", "score")
)
query("v03_recent_rerank", "WITH e AS (SELECT event_id, value / 100 AS s, epoch_us(ts) AS t FROM events), b AS (SELECT min(t) AS lo, max(t) AS hi FROM e) SELECT event_id, round(0.7 * s + 0.3 * (t - lo) / greatest(hi - lo, 1), 6) AS score FROM e, b")(
    lambda s, d: retrieval.rerank_recent(table(s, d, "events").select("event_id", (F.col("value") / 100).alias("similarity"), X.micros(F.col("ts")).alias("t"))).select("event_id", "score")
)
_COS = "list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))))"
query("v04_search_pages", f"""WITH s AS (SELECT q.vec_id AS qid, v.vec_id AS id, round({_COS}, 6) AS similarity FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0 AND v.label = q.label), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS k FROM s) SELECT qid, id, similarity FROM r WHERE k > 5 AND k <= 10""")(
    lambda s, d: retrieval.page(retrieval.nearest(*_vectors(s, d), 10, -2.0, "label"), "qid", ["rank"], 5, 5).select("qid", "id", "similarity")
)


def _vectors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries those whose id is divisible by 20."""
    e = table(s, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label"), e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"), F.col("label").alias("qlabel"))


query("v01_cosine_knn", f"""WITH s AS (SELECT q.vec_id AS qid, v.vec_id AS id, round({_COS}, 6) AS similarity FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0 AND v.label = q.label), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS INT) AS rank FROM s) SELECT qid, rank, id, similarity FROM r WHERE rank <= 10 AND similarity >= 0.2""")(
    lambda s, d: retrieval.nearest(*_vectors(s, d), 10, 0.2, "label")
)
on(source("documents"), "v06_chunks", None)(lambda t: chunking.chunk_documents(t, "doc_id", "text"))
query("v08_word_rerank", r"""WITH w AS (SELECT doc_id, n_chars, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: length(x) > 0)) AS t, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(source, '')), '[^\p{L}\p{N}]+'), lambda x: length(x) > 0)) AS u FROM documents)
  SELECT doc_id, round(0.6 * least(1.0, coalesce(n_chars, 0) / 20000.0) + 0.3 * len(list_intersect(t, ['the', 'and'])) / 2 + 0.1 * len(list_intersect(u, ['the', 'and'])) / 2, 6) AS score FROM w""")(
    lambda s, d: retrieval.rerank_by_words(table(s, d, "documents").withColumn("similarity", F.least(F.lit(1.0), F.coalesce("n_chars", F.lit(0)) / 20000.0)), "the and", "text", "source").select("doc_id", "score")
)
query("v09_merged_chunks", None)(lambda s, d: chunking.merge_chunks(chunking.chunk_documents(table(s, d, "documents"), "doc_id", "text").withColumn("score", F.col("start") * 1.0), "score"))
query("v10_fallback", "SELECT qid, id, found_by FROM (SELECT user_id AS qid, event_id AS id, 'vector' AS found_by FROM events WHERE value > 99 UNION ALL SELECT user_id, event_id, 'keyword' FROM events WHERE event_type = 'error' AND value <= 99 AND value > 90 AND user_id NOT IN (SELECT user_id FROM events WHERE value > 99 GROUP BY 1 HAVING count(*) >= 2))")(
    lambda s, d: retrieval.with_fallback((e := table(s, d, "events")).filter("value > 99").select(F.col("user_id").alias("qid"), F.col("event_id").alias("id")), e.filter("event_type = 'error' AND value > 90").select(F.col("user_id").alias("qid"), F.col("event_id").alias("id")), "qid", 2)
)
on(E, "v11_context", """WITH p AS (SELECT user_id AS qid, CASE event_type WHEN 'click' THEN 'address:' || event_id WHEN 'view' THEN 'transaction:' || event_id ELSE 'x' || event_id END AS topic FROM events)
  SELECT qid, coalesce(string_agg(topic, chr(10) ORDER BY topic) FILTER (topic LIKE 'address:%'), '') AS address, coalesce(string_agg(topic, chr(10) ORDER BY topic) FILTER (topic LIKE 'transaction:%'), '') AS transaction, coalesce(string_agg(topic, chr(10) ORDER BY topic) FILTER (topic LIKE 'x%'), '') AS other FROM p GROUP BY 1""")(
    lambda e: retrieval.context(e.select(F.col("user_id").alias("qid"), F.concat(F.when(F.col("event_type") == "click", "address:").when(F.col("event_type") == "view", "transaction:").otherwise("x"), F.col("event_id").cast("string")).alias("topic")).withColumn("text", F.col("topic")), "qid", "topic", "text")
)
query("v12_enriched", "SELECT item_id AS id, 'benchmark' AS source FROM benchmark WHERE contains(lower(text), 'e') UNION ALL SELECT doc_id, 'documents' FROM documents WHERE contains(lower(text), 'the and')")(
    lambda s, d: findings.text_search(table(s, d, "benchmark"), "e", ["text"]).select(F.col("item_id").alias("id"), F.lit("benchmark").alias("source")).unionByName(findings.text_search(table(s, d, "documents"), "the and", ["text"]).select(F.col("doc_id").alias("id"), F.lit("documents").alias("source")))
)

# Streams


def _stream(s: SparkSession, d: str) -> DataFrame:
    return flows.events_from(s, f"{d}/events.parquet*", table(s, d, "events").schema)


query("st09_stream_filter", "SELECT event_id, user_id, event_type AS kind, value, ts FROM events WHERE event_type IN ('purchase', 'error') AND value > 50")(lambda s, d: flows.run_available(flows.high_risk(_stream(s, d), ["purchase", "error"], 50)))
query("st10_stream_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")(lambda s, d: flows.run_available(flows.tumbling(_stream(s, d), "ts", ["event_type"]), "update", keys=["start", "event_type"]))
query("st13_stream_alerts", "SELECT event_id, user_id, value, CASE WHEN value >= 90 THEN 'HIGH' ELSE 'MEDIUM' END AS level FROM events WHERE value >= 60")(lambda s, d: flows.run_available(flows.alerts(_stream(s, d), 60, 1.5)))
on(E, "st16_budget_alerts", "SELECT user_id, CAST(ts AS DATE) AS day, round(sum(value), 4) AS spent, CASE WHEN sum(value) >= 150 THEN 'EXCEEDED' ELSE 'WARNING' END AS level FROM events GROUP BY 1, 2 HAVING sum(value) >= 120")(lambda e: findings.budget_alerts(e, "user_id", "ts", F.col("value"), 150, 0.8, ["event_id"]))
on(E, "st17_timeouts", "SELECT event_id, CASE WHEN value > 50 THEN 'proceed' ELSE 'abort' END AS outcome FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-15 00:00:00'")(
    lambda e: findings.timed_out(e.withColumn("status", F.when(F.col("event_type") == "signup", "open").otherwise("done")).withColumn("timeout_at", F.col("ts").cast("timestamp")), F.lit("2024-01-15 00:00:00").cast("timestamp"), F.col("value") > 50).select("event_id", "outcome")
)

# Further features

on(views.transfers, "f01_operators", "SELECT tx_id FROM transfers WHERE tx_type = 'R' AND status <> 'O' AND chain IN ('ASIA', 'EUROPE') AND value > 1000 AND value <= 60000 AND quantity >= 5 AND quantity < 45")(
    lambda t: t.filter(patterns.predicates({"tx_type": "R", "status": {"$ne": "O"}, "chain": {"$in": ["ASIA", "EUROPE"]}, "value": {"$gt": 1000, "$lte": 60000}, "quantity": {"$gte": 5, "$lt": 45}})).select("tx_id")
)
on(views.transfers, "m12_flags", "SELECT tx_id, CAST(hour(ts) AS INT) AS hour, round(value / 1000) * 1000 = value AS rounded, (value > 9000 AND value < 10000) OR (value > 4500 AND value < 5000) AS just_below FROM transfers")(
    lambda t: t.select("tx_id", F.hour("ts").alias("hour"), (F.round(F.col("value") / 1000) * 1000 == F.col("value")).alias("rounded"), X.just_below(F.col("value")).alias("just_below"))
)
on(E, "p10_typed_json", """SELECT event_id, '{"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","user_id":' || user_id || '}' AS json FROM events""")(
    lambda e: e.select("event_id", F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), "user_id")).alias("json"))
)
on(E, "x09_maps", "SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY n DESC, event_type) AS entries, coalesce(max(CASE WHEN event_type = 'click' THEN n END), 0) AS clicks FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")(
    lambda e: X.sorted_entries(e.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m")), "user_id", "m", "click")
)
on(P, "m05_autoregression", """WITH p AS (SELECT *, lag(price) OVER (PARTITION BY token ORDER BY day) AS b FROM price_series), q AS (SELECT * FROM p WHERE b IS NOT NULL), l AS (SELECT token, regr_slope(price, b) AS s, regr_intercept(price, b) AS i FROM q GROUP BY 1),
  r AS (SELECT q.token, day, price - (i + s * b) AS r FROM q JOIN l ON q.token = l.token), d AS (SELECT token, stddev_pop(r) AS d FROM r GROUP BY 1) SELECT r.token, day, round(r, 3) AS residual FROM r JOIN d ON r.token = d.token WHERE abs(r) > 3 * d""")(lambda s: series.autoregression_outliers(s, "token", "day", "price", 3))
on(P, "m05_without_extremes", None)(lambda s: series.without_extremes(s, "token", "day", "price", 5, 3.0, written))
on(P, "m05_generalised_esd", None)(lambda s: series.generalised_esd(s, "token", "day", "price", 5, 0.05, written))
