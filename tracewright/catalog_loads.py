"""Queries of sources, loads, projections and validation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright import views
from tracewright.lineage import shared_folder
from tracewright.operators import loading, upserts
from tracewright.registry import on, query, source
from tracewright.sources import files
from tracewright.views import table

R, T, G, D = views.raw_transfers, views.transfers, views.graph_nodes, views.trades
RULES = files.Rules(required=("hash", "from", "to", "value", "timestamp"), evm=("from", "to"), amounts=("value",), times=("timestamp",))
_GOOD = """hash IS NOT NULL AND regexp_matches("from", '^0x[a-fA-F0-9]{40}$') AND regexp_matches("to", '^0x[a-fA-F0-9]{40}$') AND try_cast(value AS DOUBLE) >= 0 AND try_strptime(timestamp, '%Y-%m-%d %H:%M:%S') IS NOT NULL"""


def _csv(df: DataFrame, **options: str) -> str:
    """df as a folder of delimited files in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/files-{uuid.uuid4().hex}"
    df.write.options(header=True, **options).csv(path)
    return path


query("s01_csv_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")(lambda s, d: files.scan(s, _csv(table(s, d, "nation")), "n_nationkey int, n_name string, n_regionkey int"))
query("s02_csv_options", "SELECT c_custkey, c_name, c_mktsegment FROM customer")(
    lambda s, d: files.scan(s, _csv(table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), sep=";", encoding="ISO-8859-1"), "c_custkey long, c_name string, c_mktsegment string", ";", "ISO-8859-1")
)
on(source("events"), "s03_sample_and_count", "SELECT event_id, user_id, (SELECT count(*) FROM events) AS total_rows FROM events ORDER BY event_id LIMIT 1000")(lambda e: files.sample_and_count(e.select("event_id", "user_id"), ["event_id"], 1000))
on(G, "s06_label_scan", "SELECT id, nation FROM graph_nodes WHERE label = 'Customer' AND segment = 'BUILDING' AND chain = 'ASIA'")(lambda n: n.filter("label = 'Customer' AND segment = 'BUILDING' AND chain = 'ASIA'").select("id", "nation"))
query("s07_edge_with_ends", """SELECT t.tx_id, a.label AS src_label, a.nation AS src_nation, b.label AS dst_label, b.nation AS dst_nation FROM transfers t JOIN graph_nodes a ON t.src = a.id JOIN graph_nodes b ON t.dst = b.id""")(
    lambda s, d: views.transfers_with_ends(s, d)
)
query("s20_schema_scan", """SELECT 'label' AS kind, label AS name, count(*) AS n FROM graph_nodes GROUP BY label UNION ALL SELECT 'edge', tx_type, count(*) FROM transfers GROUP BY tx_type
  UNION ALL SELECT 'property', k, count(*) FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY k""")(
    lambda s, d: G(s, d).groupBy(F.lit("label").alias("kind"), F.col("label").alias("name")).agg(F.count("*").alias("n"))
    .unionByName(T(s, d).groupBy(F.lit("edge").alias("kind"), F.col("tx_type").alias("name")).agg(F.count("*").alias("n")))
    .unionByName(table(s, d, "events").select(F.explode(F.json_object_keys("props")).alias("name")).groupBy(F.lit("property").alias("kind"), "name").agg(F.count("*").alias("n")))
)

on(R, "p01_rename", 'SELECT hash AS tx_hash, "from" AS from_address, "to" AS to_address, kind FROM raw_transfers')(
    lambda r: files.rename(r.select("hash", "from", "to", "kind"), {"hash": "tx_hash", "from": "from_address", "to": "to_address", "gas": "gas_used"})
)
on(R, "p02_p03_coerce", "SELECT hash, try_strptime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, try_cast(value AS DOUBLE) AS value FROM raw_transfers")(
    lambda r: files.coerce(r.select("hash", "timestamp", "value"), files.time_columns(r), ["value"])
)
on(R, "p04_fill_zero", "SELECT hash, coalesce(try_cast(value AS DOUBLE), 0.0) AS value FROM raw_transfers")(lambda r: files.coerce(r.select("hash", "value"), [], ["value"]).fillna(0.0, ["value"]))
on(R, "p05_fill_medians", """WITH v AS (SELECT hash, kind, try_cast(value AS DOUBLE) AS value FROM raw_transfers), m AS (SELECT kind, median(value) AS m FROM v GROUP BY 1)
  SELECT hash, v.kind, round(coalesce(value, m), 6) AS value FROM v JOIN m ON v.kind = m.kind""")(
    lambda r: files.fill_medians(files.coerce(r.select("hash", "kind", "value"), [], ["value"]), ["value"], "kind").select("hash", "kind", F.round("value", 6).alias("value"))
)
on(G, "p08_node_texts", """SELECT id, label || ' ' || id || ' (' || concat_ws(', ', 'chain: ' || chain, 'nation: ' || nation, 'segment: ' || segment) || ')' AS text FROM graph_nodes""")(
    lambda n: loading.node_texts(n, "id", "label", ["nation", "chain", "segment"])
)
on(T, "p08_neighbour_texts", """WITH p AS (SELECT DISTINCT src, dst FROM transfers), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS k, count(*) OVER (PARTITION BY src) AS n FROM p)
  SELECT src, string_agg(dst, ', ' ORDER BY dst) FILTER (k <= 5) || CASE WHEN max(n) > 5 THEN ' and ' || (max(n) - 5) || ' more' ELSE '' END AS text FROM r GROUP BY src""")(lambda t: loading.first_few(t, "src", "dst"))
on(source("events"), "p11_flat_rows", "SELECT user_id, event_id, value FROM events WHERE event_type = 'signup'")(
    lambda e: e.filter("event_type = 'signup'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_list(F.struct("event_id", "value")).alias("result")).select("user_id", F.inline("result"))
)
on(views.balances, "p12_top_holdings", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY amount DESC, token) AS k FROM balances) SELECT wallet, string_agg(token, ',' ORDER BY k) AS entries FROM r WHERE k <= 10 GROUP BY 1""")(
    lambda b: loading.top_entries(b, "wallet", "token", "amount")
)

on(R, "f11_addresses", """SELECT hash, regexp_matches("from", '^0x[a-fA-F0-9]{40}$') AS evm, length("from") BETWEEN 26 AND 35 AS btc FROM raw_transfers""")(
    lambda r: r.select("hash", files.is_evm_address(F.col("from")).alias("evm"), files.is_btc_address(F.col("from")).alias("btc"))
)
on(R, "f12_faults", """SELECT kind, concat_ws(',', CASE WHEN hash IS NULL THEN 'required:hash' END, CASE WHEN NOT regexp_matches("from", '^0x[a-fA-F0-9]{40}$') THEN 'evm:from' END,
    CASE WHEN NOT coalesce(try_cast(value AS DOUBLE) >= 0, false) THEN 'amount:value' END, CASE WHEN try_strptime(timestamp, '%Y-%m-%d %H:%M:%S') IS NULL THEN 'time:timestamp' END) AS faults, count(*) AS n FROM raw_transfers GROUP BY 1, 2""")(
    lambda r: files.faults(r, RULES).groupBy("kind", F.array_join("faults", ",").alias("faults")).agg(F.count("*").alias("n"))
)
query("f13_formats", "SELECT * FROM (VALUES ('custom'), ('token_transfers'), ('transfers')) AS v(format)")(lambda s, d: s.createDataFrame([(f,) for f in files.formats_met(R(s, d))], "format string"))
on(R, "f14_valid_rows", f'SELECT hash, "from", "to", value FROM raw_transfers WHERE {_GOOD}')(lambda r: files.valid_rows(r, RULES).select("hash", "from", "to", "value"))
on(R, "u06_invalid_union", """SELECT DISTINCT hash FROM raw_transfers WHERE hash IS NOT NULL AND (NOT regexp_matches("from", '^0x[a-fA-F0-9]{40}$') OR NOT coalesce(try_cast(value AS DOUBLE) >= 0, false))""")(
    lambda r: files.faults(r, files.Rules(evm=("from",))).filter(F.size("faults") > 0).select("hash").union(files.faults(r, files.Rules(amounts=("value",))).filter(F.size("faults") > 0).select("hash")).filter("hash is not null").distinct()
)

_VALID = f'SELECT hash, "from" AS src, "to" AS dst, CAST(value AS DOUBLE) AS value, token, kind, chain FROM raw_transfers WHERE {_GOOD}'


def _valid(r: DataFrame) -> DataFrame:
    return files.coerce(files.valid_rows(r, RULES), [], ["value"]).withColumnsRenamed({"from": "src", "to": "dst"})


def _all_text(*parts: DataFrame) -> DataFrame:
    """Nodes and edges in one table: kind, src, dst, value."""
    found = None
    for p in parts:
        p = p.select(F.coalesce(p["label"] if "label" in p.columns else p["kind"], F.lit("")).alias("kind"), (p["id"] if "id" in p.columns else p["src"]).alias("src"), (p["dst"] if "dst" in p.columns else F.lit(None).cast("string")).alias("dst"), (p["value"] if "value" in p.columns else F.lit(None).cast("double")).alias("value"))
        found = p if found is None else found.unionByName(p)
    return found


_NODES = "SELECT DISTINCT 'Address' AS kind, unnest([src, dst]) AS src, NULL AS dst, NULL::DOUBLE AS value FROM v"
_EDGES = "SELECT '{}', src, dst, value FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY value DESC, src DESC, dst DESC) AS k FROM v) WHERE k = 1"
on(R, "k01_transfer_load", f"WITH v AS ({_VALID}) {_NODES} UNION ALL {_EDGES.format('TRANSFER')}")(lambda r: _all_text(loading.endpoints(v := _valid(r), "src", "dst"), loading.edges(v, "TRANSFER", "src", "dst", "hash", "value")))
on(R, "k02_token_load", f"WITH v AS ({_VALID}) {_NODES} UNION ALL SELECT DISTINCT 'Token', token, NULL, NULL FROM v UNION ALL {_EDGES.format('TOKEN_TRANSFER')} UNION ALL SELECT DISTINCT 'HOLDS', unnest([src, dst]), token, NULL FROM v")(
    lambda r: _all_text(loading.endpoints(v := _valid(r), "src", "dst"), loading.endpoints(v, "token", label="Token"), loading.edges(v, "TOKEN_TRANSFER", "src", "dst", "hash", "value"), loading.relations(v, "HOLDS", [("src", "token"), ("dst", "token")]))
)
on(D, "k03_trade_load", """SELECT DISTINCT 'Trader' AS kind, CAST(trader AS VARCHAR) AS src, NULL AS dst, NULL::DOUBLE AS value FROM trades UNION ALL SELECT DISTINCT 'Dex', dex, NULL, NULL FROM trades UNION ALL SELECT DISTINCT 'Token', unnest([bought, sold]), NULL, NULL FROM trades
  UNION ALL SELECT 'TRADE', CAST(trader AS VARCHAR), dex, amount FROM trades UNION ALL SELECT DISTINCT 'INTERACTS_WITH', CAST(trader AS VARCHAR), unnest([bought, sold]), NULL FROM trades""")(
    lambda t: _all_text(loading.endpoints(v := t.withColumn("trader", F.col("trader").cast("string")), "trader", label="Trader"), loading.endpoints(v, "dex", label="Dex"), loading.endpoints(v, "bought", "sold", label="Token"), loading.edges(v, "TRADE", "trader", "dex", "place", "amount"), loading.relations(v, "INTERACTS_WITH", [("trader", "bought"), ("trader", "sold")]))
)
on(G, "k04_attributes", "SELECT id, concat_ws(',', 'nation=' || nation, 'segment=' || segment) AS properties FROM graph_nodes")(
    lambda n: loading.with_properties(n, "id", ["nation", "segment"]).select("id", F.array_join(F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("properties"))
)
on(R, "k06_create", 'SELECT hash, "from" AS src FROM raw_transfers UNION ALL SELECT hash, "to" FROM raw_transfers')(lambda r: r.select("hash", F.col("from").alias("src")).unionByName(r.select("hash", F.col("to").alias("src"))))
on(R, "k11_routing", """SELECT chain, CASE kind WHEN 'send' THEN 'SENT' WHEN 'receive' THEN 'RECEIVED' WHEN 'mint' THEN 'MINTED' WHEN 'swap' THEN 'SWAPPED' ELSE 'CALLED' END AS edge, count(*) AS n, round(sum(coalesce(try_cast(value AS DOUBLE), 0.0)), 2) AS value FROM raw_transfers GROUP BY 1, 2""")(
    lambda r: loading.routed(files.coerce(r, [], ["value"]).fillna(0.0, ["value"]), "kind").groupBy("chain", "edge").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
)


@query("k12_write_by_type", "SELECT kind, count(*) AS n FROM raw_transfers GROUP BY 1")
def k12_write_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/edges-{uuid.uuid4().hex}"
    R(spark, sf_dir).hint("rebalance", "kind").write.partitionBy("kind").parquet(path)
    return spark.read.parquet(path).groupBy("kind").agg(F.count("*").alias("n"))


query("k13_node_metrics", """WITH o AS (SELECT src AS id, count(*) AS n_out, sum(value) AS v_out FROM transfers GROUP BY 1), i AS (SELECT dst AS id, count(*) AS n_in, sum(value) AS v_in FROM transfers GROUP BY 1)
  SELECT n.id, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in, round(coalesce(v_in, 0.0) - coalesce(v_out, 0.0), 4) AS net_flow FROM graph_nodes n LEFT JOIN o ON n.id = o.id LEFT JOIN i ON n.id = i.id""")(
    lambda s, d: upserts.keep_all(
        G(s, d).select("id"),
        T(s, d).select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), (-F.col("value")).alias("v")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.col("value").alias("v")))).alias("e"))
        .groupBy("e.id").agg(F.sum("e.o").alias("n_out"), F.sum("e.i").alias("n_in"), F.sum("e.v").alias("net_flow")),
        "id", {"n_out": 0, "n_in": 0, "net_flow": 0.0},
    ).select("id", "n_out", "n_in", F.round("net_flow", 4).alias("net_flow"))
)
query("k14_write_back", """WITH g AS (SELECT src AS id, count(DISTINCT dst) AS partners FROM transfers GROUP BY 1) SELECT n.id, n.label, coalesce(partners, 0) AS partners FROM graph_nodes n LEFT JOIN g ON n.id = g.id""")(
    lambda s, d: upserts.keep_all(G(s, d).select("id", "label"), T(s, d).groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("partners")), "id", {"partners": 0})
)
on(G, "k15_tagged_rows", "SELECT id, 'holders' AS _query_name, TIMESTAMP '2024-01-31 00:00:00' AS _timestamp FROM graph_nodes")(
    lambda n: n.select("id", F.lit("holders").alias("_query_name"), F.lit("2024-01-31 00:00:00").cast("timestamp").alias("_timestamp"))
)
query("k16_vector_upsert", """SELECT vec_id, CASE WHEN label % 2 = 0 THEN label + 100 ELSE label END AS label FROM embeddings""")(
    lambda s, d: upserts.merge(e := table(s, d, "embeddings").select("vec_id", "label", "embedding"), e.filter("label % 2 = 0").withColumn("label", F.col("label") + 100), ["vec_id"]).select("vec_id", "label")
)
on(source("events"), "k18_export_json", """SELECT event_id, '{"event_type":"' || event_type || '","user_id":' || user_id || '}' AS json FROM events""")(lambda e: e.select("event_id", F.to_json(F.struct("event_type", "user_id")).alias("json")))
query("k21_create_one", "SELECT id, label FROM graph_nodes UNION ALL SELECT 'X1', 'Wallet'")(lambda s, d: G(s, d).select("id", "label").unionByName(s.createDataFrame([("X1", "Wallet")], "id string, label string")))
query("k23_two_part_keys", """WITH o AS (SELECT chain, src AS address, min(value) AS low, NULL::DOUBLE AS high FROM transfers GROUP BY 1, 2), n AS (SELECT chain, src AS address, NULL::DOUBLE AS low, max(value) AS high FROM transfers WHERE tx_type = 'R' GROUP BY 1, 2)
  SELECT coalesce(o.chain, n.chain) AS chain, coalesce(o.address, n.address) AS address, round(coalesce(n.low, o.low), 4) AS low, round(coalesce(n.high, o.high), 4) AS high FROM o FULL JOIN n ON o.chain = n.chain AND o.address = n.address""")(
    lambda s, d: upserts.merge_partial(
        (t := T(s, d)).groupBy("chain", F.col("src").alias("address")).agg(F.min("value").alias("low"), F.lit(None).cast("double").alias("high")),
        t.filter("tx_type = 'R'").groupBy("chain", F.col("src").alias("address")).agg(F.lit(None).cast("double").alias("low"), F.max("value").alias("high")), ["chain", "address"],
    ).select("chain", "address", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))
)
query("k24_replace_documents", """WITH o AS (SELECT doc_id, 0 AS chunk_index, text AS content FROM documents), n AS (SELECT doc_id, 1 AS chunk_index, 'new' AS content FROM documents WHERE lang = 'de')
  SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n""")(
    lambda s, d: loading.replace_rows((t := table(s, d, "documents")).select("doc_id", F.lit(0).alias("chunk_index"), F.col("text").alias("content")), t.filter("lang = 'de'").select("doc_id", F.lit(1).alias("chunk_index"), F.lit("new").alias("content")), "doc_id")
)
on(source("events"), "k25_delete_events", "SELECT event_type, count(*) AS kept FROM events WHERE NOT (event_type = 'error' AND value < 50) GROUP BY 1")(lambda e: e.filter(~F.coalesce((F.col("event_type") == "error") & (F.col("value") < 50), F.lit(False))).groupBy("event_type").agg(F.count("*").alias("kept")))
