"""Approximate search, and embeddings of the elements of graphs and of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewright import views
from tracewright.lineage import written
from tracewright.operators import element_vectors, evaluation, graph_network, vector_index
from tracewright.registry import query
from tracewright.views import table


@query("v01_inverted_file", None)
def inverted_file(s: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of those whose id is divisible by 20, among all."""
    e = table(s, d, "embeddings")
    items = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    index = vector_index.learn(items)
    if index is None:
        return s.createDataFrame([], "qid long, rank int, id long, similarity double, looked long")
    return vector_index.search(items, vector_index.indexed(items, index), index, asked, 10)


def _shown(v: str) -> Column:
    return F.array_join(F.transform(v, lambda x: x.cast("string")), ",").alias("v")


_SIGN = "CASE WHEN substr(md5({c}), k, 1) >= '8' THEN 1000000 ELSE -1000000 END"
_DESCRIBED = "SELECT id, label || ' of ' || nation || ' in ' || chain || coalesce(' for ' || segment, '') AS text FROM graph_nodes"
_TEXTS = rf"""w AS (SELECT id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: length(x) > 0))) AS w FROM described),
  t AS (SELECT id, k, CAST(round(sum({_SIGN.format(c="w")}) / count(*)) AS BIGINT) AS v FROM w, range(1, 33) r(k) GROUP BY id, k), tv AS (SELECT id, string_agg(v::VARCHAR, ',' ORDER BY k) AS v FROM t GROUP BY id)"""
_GRAPH = f"""b AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM transfers UNION ALL SELECT dst, src FROM transfers)),
  v0 AS (SELECT node, k, {_SIGN.format(c="node")} AS v FROM (SELECT DISTINCT src AS node FROM b), range(1, 33) r(k)),
  v1 AS MATERIALIZED (SELECT b.src AS node, k, CAST(round(sum(v) / count(*)) AS BIGINT) AS v FROM b JOIN v0 ON v0.node = b.dst GROUP BY 1, 2),
  v2 AS (SELECT b.src AS node, k, CAST(round(sum(v) / count(*)) AS BIGINT) AS v FROM b JOIN v1 ON v1.node = b.dst GROUP BY 1, 2),
  n AS MATERIALIZED (SELECT node, k, sum(v) AS v FROM (SELECT * FROM v1 UNION ALL SELECT * FROM v2) GROUP BY 1, 2)"""


def _described(s: SparkSession, d: str) -> DataFrame:
    return views.graph_nodes(s, d).select("id", F.concat(F.col("label"), F.lit(" of "), F.col("nation"), F.lit(" in "), F.col("chain"), F.coalesce(F.concat(F.lit(" for "), F.col("segment")), F.lit(""))).alias("text"))


@query("v05_v13_node_vectors", f"WITH described AS ({_DESCRIBED}), {_TEXTS} SELECT 'node_' || d.id || '_node' AS id, 'node' AS strategy, d.text, tv.v FROM described d JOIN tv ON tv.id = d.id UNION ALL SELECT * FROM (WITH {_GRAPH} SELECT 'node_' || node || '_neighbourhood', 'neighbourhood', (SELECT any_value(text) FROM described x WHERE x.id = node), string_agg(CAST(v AS BIGINT)::VARCHAR, ',' ORDER BY k) FROM n GROUP BY node)")
def node_vectors(s: SparkSession, d: str) -> DataFrame:
    """Each account by its description, and by whom it deals with."""
    texts, flow = _described(s, d), views.transfers(s, d).select("src", "dst")
    own = element_vectors.elements("node", "node", element_vectors.text_vectors(texts, "id", "text"), "id", texts)
    near = element_vectors.elements("node", "neighbourhood", element_vectors.neighbourhoods(flow, cells=element_vectors.blocks(flow, views.parts(views.table(s, d, "lineitem")))).withColumnRenamed("node", "id"), "id", texts)
    return own.unionByName(near).select("id", "strategy", "text", _shown("v"))


@query("v13_edge_and_subgraph_vectors", f"WITH {_GRAPH}, m AS (SELECT 'edge_' || src || '>' || dst || '_edge' AS id, unnest([src, dst]) AS node FROM (SELECT DISTINCT src, dst FROM transfers) UNION ALL SELECT 'subgraph_' || src || '_subgraph', dst FROM b UNION ALL SELECT DISTINCT 'subgraph_' || src || '_subgraph', src FROM b), g AS (SELECT id, k, CAST(round(sum(v) / count(*)) AS BIGINT) AS v FROM m JOIN n ON n.node = m.node GROUP BY 1, 2) SELECT id, string_agg(v::VARCHAR, ',' ORDER BY k) AS v FROM g GROUP BY id")
def edge_and_subgraph_vectors(s: SparkSession, d: str) -> DataFrame:
    """Each pair that deals, by both ends; each account with all that it deals with."""
    cells = element_vectors.blocks(views.transfers(s, d).select("src", "dst"), views.parts(views.table(s, d, "lineitem")))
    vectors = written(element_vectors.neighbourhoods(None, cells=cells))
    means = {"edge": element_vectors.edge_means(cells, vectors), "subgraph": element_vectors.ball_means(cells, vectors)}
    found = [element_vectors.elements(kind, kind, mean, "key").select("id", _shown("v")) for kind, mean in means.items()]
    return found[0].unionByName(found[1])


FEATURES = ["balance", "supplier", "transfers", "value"]


def exposure(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Accounts (node, features of mean 0 and deviation 1, label, held_out) and pairs that deal (src, dst).

    label: 1 if more of an account's partners than of all accounts' partners owe money, which its own features don't tell.
    """
    flow, known = views.transfers(s, d).select("src", "dst", "value"), views.graph_nodes(s, d).select("id", "label", "balance")
    pairs = written(flow.select("src", "dst").distinct())
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    owes = both.join(known.select(F.col("id").alias("dst"), (F.col("balance") < 0).cast("int").alias("owes")), "dst").groupBy("src").agg(F.sum("owes").alias("owing"), F.count("*").alias("partners"))
    ends = flow.select(F.col("src").alias("id"), "value").unionByName(flow.select(F.col("dst").alias("id"), "value")).groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("v"))
    rows = written(known.join(ends, "id").join(owes.withColumnRenamed("src", "id"), "id").select("id", F.col("balance").cast("double").alias("balance"), (F.col("label") == "Supplier").cast("double").alias("supplier"), F.log1p("n").alias("transfers"), F.log1p("v").alias("value"), "owing", "partners"))
    stats = rows.agg(F.sum("owing").alias("o"), F.sum("partners").alias("p"), *[x.alias(f"{k}_{f}") for f in FEATURES for k, x in (("m", F.round(F.avg(f), 9)), ("s", F.round(F.stddev_pop(f), 9)))]).first()
    scaled = [((F.col(f) - F.lit(stats[f"m_{f}"] or 0.0)) / F.lit(stats[f"s_{f}"] or 1.0)).alias(f) for f in FEATURES]
    share = (stats["o"] or 0) / stats["p"] if stats["p"] else 0.0
    held_out = F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(5)) == 0
    return rows.select(F.col("id").alias("node"), *scaled, (F.col("owing") / F.col("partners") > share).cast("int").alias("label"), held_out.alias("held_out")), pairs


def graph_networks(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Probabilities of all accounts by the network and by its twin without neighbours; and the accounts."""
    nodes, pairs = exposure(s, d)
    made = graph_network.blocks(nodes, pairs, FEATURES, 40)
    learn = written(made.join(nodes.filter("NOT held_out").select("node", F.col("label").cast("double").alias("_y"), F.lit(1.0).alias("_w")), "node"))
    nets = {name: graph_network.fit(learn, 2 * len(FEATURES), 12, 60, near=near)[0] for name, near in (("network", True), ("alone", False))}
    return written(graph_network.predicted(made, nets)), nodes


@query("g40_graph_network", None)
def graph_network_figures(s: SparkSession, d: str) -> DataFrame:
    """Figures on held-out accounts of the network and of its twin that sees a node's own features alone."""
    scores, nodes = graph_networks(s, d)
    held = scores.join(nodes.filter("held_out").select("node", "label"), "node")
    return evaluation.figures(held, F.col("label"), ["network", "alone"])


@query("g44_network_ranking", None)
def network_ranking(s: SparkSession, d: str) -> DataFrame:
    """Every account's probability, whether it is flagged, and its band."""
    scores, _ = graph_networks(s, d)
    return graph_network.ranked(scores.select("node", "network"), "network")
