"""Transfers with both ends against the join of the views, with keys that repeat, are null or lead nowhere."""

from collections import Counter

from pyspark.sql import functions as F

from tracewright import catalog, views


def test_ends_as_from_the_views_without_shuffling_texts(spark, tmp_path):
    d = str(tmp_path)
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    put("region", [(0, "ASIA")], "r_regionkey int, r_name string")
    put("nation", [(1, "JAPAN", 0), (2, "NOWHERE", 9)], "n_nationkey int, n_name string, n_regionkey int")
    put("customer", [(1, 1, "A", 1.0), (1, 1, "A", 2.0), (2, 2, "A", 1.0), (3, 1, "B", 0.0)], "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double")
    put("supplier", [(7, 1, 1.0), (8, 1, 1.0), (8, 1, 2.0), (9, 2, 1.0)], "s_suppkey long, s_nationkey int, s_acctbal double")
    put("orders", [(10, 1), (11, 2), (12, 3), (13, None), (14, 99)], "o_orderkey long, o_custkey long")
    lines = [(o, p, s, n) for n, (o, s) in enumerate([(10, 7), (10, 8), (11, 7), (12, 8), (12, 9), (12, None), (13, 7), (14, 7), (None, 7), (12, 7)]) for p in (5, None)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"
    extra = [F.lit(1.0).alias(c) for c in ("l_extendedprice", "l_discount", "l_quantity")] + [F.lit("x").alias(c) for c in ("l_returnflag", "l_linestatus")] + [F.current_timestamp().alias("l_shipdate")]
    spark.createDataFrame(lines, schema).select("*", *extra).write.parquet(f"{d}/lineitem.parquet")
    a, b = (views.graph_nodes(spark, d).select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"), F.col("nation").alias(f"{end}_nation")) for end in ("src", "dst"))
    want = views.transfers(spark, d).select("tx_id", "src", "dst").join(a, "src").join(b, "dst").drop("src", "dst")
    got = catalog.QUERIES["s07_edge_with_ends"](spark, d)
    assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) and not got.isEmpty()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any("concat" in line for line in plan.splitlines()[1:])  # texts are made above all joins
