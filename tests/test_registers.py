"""Registers in slices: sets counted, the same in any number of slices, and no sketch along an edge."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.lineage import written
from tracewright.operators import graph, registers


def shuffled(spark):
    none = (spark._sc._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, *none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_sketches_do_not_go_along_edges(spark, conf):
    rng = random.Random(5)
    df = written(spark.createDataFrame([(rng.randrange(1500), rng.randrange(1500)) for _ in range(40_000)], "src long, dst long").repartition(4))
    for key, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.shuffle.partitions", "24")):
        conf.set(key, value)  # many tasks, as on a cluster
    before = shuffled(spark)
    rows = graph.reach_sketches(df).collect()
    assert shuffled(spark) - before < 50_000_000  # a sketch of 4 kB for each node and task that has an edge into it is more in a round
    last = max(r["hops"] for r in rows)
    assert all(abs(r["n"] / 1500 - 1) < 4 * 1.04 / 64 for r in rows if r["hops"] == last)


@pytest.fixture
def conf(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    yield spark.conf
    for key, value in held.items():
        spark.conf.set(key, value)


def test_any_slices_give_the_same(spark, monkeypatch):
    edges = spark.createDataFrame([(a, a + 1) for a in range(30)] + [(40, 5), (41, 5)], "src long, dst long")
    numbers = spark.createDataFrame([(i,) for i in range(42)], "ordinal long").withColumn("hash", F.xxhash64("ordinal"))
    found = []
    for least, small in ((1, 0), (5, 0), (64, 0)):
        monkeypatch.setattr(registers, "SLICES", least)
        monkeypatch.setattr(registers, "SMALL", small)
        found.append(sorted(map(tuple, registers.balls(edges, numbers, 42, 3, 7, written).collect())))
    assert found[0] == found[1] == found[2]
    assert {n for o, h, n in found[0] if h == 0} == {1} and [n for o, h, n in found[0] if (o, h) == (40, 3)] == [1]
