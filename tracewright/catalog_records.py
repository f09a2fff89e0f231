"""Small operations on records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright import views
from tracewright.lineage import shared_folder
from tracewright.operators import records
from tracewright.registry import on, query, source
from tracewright.views import table

E = source("events")

on(E, "f05_frequency", "SELECT user_id, min(ts) AS first, count(*) AS n FROM (SELECT user_id, ts, lead(ts, 2) OVER (PARTITION BY user_id ORDER BY ts) AS a FROM events) WHERE epoch_us(a) - epoch_us(ts) <= 14400000000 GROUP BY 1")(
    lambda e: records.bursts(e.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", 3, 14_400)
)
on(views.graph_nodes, "f32_key_pattern", "SELECT id FROM graph_nodes WHERE starts_with(id, 'C1')")(lambda n: records.with_prefix(n, "id", "C1*").select("id"))
on(source("benchmark"), "f33_saved_search", "SELECT item_id FROM benchmark WHERE contains(lower(text), 'th') ORDER BY item_id LIMIT 20 OFFSET 5")(lambda b: records.term_search(b, "Th", ["text"], ["item_id"], 5, 20).select("item_id"))
query("p09_drawn_graph", """SELECT CAST(src AS VARCHAR) AS "from", CAST(dst AS VARCHAR) AS "to", CAST(n AS VARCHAR) AS label, 'to' AS arrows, CASE WHEN value / n / 100 > 0.7 THEN 'red' WHEN value / n / 100 > 0.4 THEN 'orange' ELSE 'green' END AS colour FROM pair_flow""")(
    lambda s, d: (f := views.pair_flow(s, d)).join(records.drawn_edges(f, "n"), (f["src"].cast("string") == F.col("from")) & (f["dst"].cast("string") == F.col("to"))).select("from", "to", "label", "arrows", records.band_colour(F.col("value") / F.col("n") / 100).alias("colour"))
)
on(views.raw_transfers, "k22_demonstration_load", """SELECT "from" AS address, count(*) AS n, CASE WHEN "from" IN (SELECT '0x' || md5('1') || substr(md5('x1'), 1, 8)) THEN 'mixer' WHEN "from" LIKE 'bad%' AND "from" IN ('bad31', 'bad62') THEN 'broken' END AS scenario FROM raw_transfers WHERE kind NOT IN ('mint', 'swap') OR kind IS NULL GROUP BY 1""")(
    lambda r: records.labelled(records.without_kinds(r, "kind", ["mint", "swap"]).groupBy(F.col("from").alias("address")).agg(F.count("*").alias("n")), "address", {"mixer": ["0xc4ca4238a0b923820dcc509a6f75849b6dbf9ac2"], "broken": ["bad31", "bad62"]})
)


@query("a68_load_statistics", "SELECT count(*) AS records, count(CASE WHEN event_id % 3 = 0 THEN 1 END) AS merged, count(CASE WHEN event_id % 3 <> 0 THEN 1 END) AS created, CAST(sum(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 2 END) AS BIGINT) AS properties, (SELECT count(*) FROM events) AS stored FROM events WHERE event_id % 2 = 0 OR event_id % 3 <> 0")
def load_statistics(s: SparkSession, d: str) -> DataFrame:
    """A load of events into those that are there, every third of them."""
    events = E(s, d).select("event_id", "user_id", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type"))
    known, rows = events.filter("event_id % 3 = 0"), events.filter("event_id % 2 = 0 OR event_id % 3 <> 0")
    stored, counts = records.merged_with_statistics(known, rows, "event_id", f"{shared_folder(s)}/load-{uuid.uuid4().hex}")
    return s.createDataFrame([(counts["records"], counts["merged"], counts["created"], counts["properties"], stored.count())], "records long, merged long, created long, properties long, stored long")


on(E, "a71_queues", "SELECT event_type AS queue, count(CASE WHEN value < 50 THEN 1 END) AS waiting, count(CASE WHEN value >= 50 THEN 1 END) AS running, count(DISTINCT CASE WHEN value >= 50 THEN user_id END) AS workers FROM events GROUP BY 1")(
    lambda e: records.queues(e.withColumnRenamed("event_type", "queue"), "queue", "user_id", F.col("value") >= 50)
)
on(E, "x14_call_costs", "SELECT event_id, round(CASE event_type WHEN 'view' THEN 0.001 * value WHEN 'purchase' THEN 0.02 * value ELSE 0.0 END, 6) AS cost FROM events")(
    lambda e: records.costs(e, "event_type", F.col("value"), {"view": 0.001, "purchase": 0.02}).select("event_id", "cost")
)
query("x04_digests", """SELECT doc_id, md5('{"doc_id":' || doc_id || ',"lang":' || coalesce('"' || lang || '"', 'null') || ',"source":' || coalesce('"' || source || '"', 'null') || '}') AS row_md5, md5(text) AS text_md5 FROM documents""")(
    lambda s, d: table(s, d, "documents").select("doc_id", records.digest(["source", "lang", "doc_id"]).alias("row_md5"), F.md5(F.col("text").cast("binary")).alias("text_md5"))
)
on(E, "t04_safe_limit", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 1000")(lambda e: records.limited(e.select("event_id", "value").withColumn("_o", -F.col("value")), ["_o", "event_id"]).drop("_o"))
