"""Graph operators on hand-made graphs."""

from datetime import datetime, timedelta

from tracewright.operators import graph

START = datetime(2024, 1, 1)


def edges(spark, rows):
    return spark.createDataFrame([(a, b, float(v), START + timedelta(minutes=m)) for a, b, v, m in rows], "src string, dst string, value double, ts timestamp")


def test_two_cycle_and_triangle_are_found_once(spark):
    two = graph.cycles(edges(spark, [("A", "B", 100, 0), ("B", "A", 98, 30)]), 2, 5).collect()
    assert [(r["nodes"][:2], r["length"], r["total"], r["balanced"]) for r in two] == [(["A", "B"], 2, 198.0, True)]
    three = graph.cycles(edges(spark, [("A", "B", 10, 0), ("B", "C", 10, 5), ("C", "A", 10, 9)]), 2, 5).collect()
    assert [r["length"] for r in three] == [3]


def test_peel_chain(spark):
    chain = edges(spark, [("A", "B", 100, 0), ("B", "C", 60, 1), ("C", "D", 30, 2), ("D", "E", 20, 3)])
    found = {"".join(r["nodes"]): (r["confidence"], r["risk"]) for r in graph.decaying_paths(chain, 0.7, 4, 5).collect()}
    assert found["ABCDE"] == (0.6, 60)
    assert set(found) == {"ABCD", "BCDE", "ABCDE"}
    flat = edges(spark, [("A", "B", 100, 0), ("B", "C", 90, 1), ("C", "D", 80, 2)])
    assert graph.decaying_paths(flat, 0.7, 4, 5).isEmpty()


def test_hub_of_layering(spark):
    hub = edges(spark, [("A", "H", 50, 0), ("B", "H", 50, 1), ("H", "C", 48, 5), ("H", "D", 48, 6)])
    (row,) = graph.hubs(hub).collect()
    assert (row["node"], row["confidence"], row["ratio"], row["risk"]) == ("H", 0.9, 0.96, 96.2)


def test_components_of_a_long_chain_and_of_no_edges(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "src int, dst int")
    found = {r["node"]: r["component"] for r in graph.components(chain).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert graph.components(chain.limit(0)).isEmpty()
