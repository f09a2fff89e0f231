"""Guards, the event log and deliveries: against plain folds, across restarts, after a death between two sinks, with nulls, ties and nothing."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tracewright.streaming import flows, guards, log

CALLS = "provider string, ts timestamp, call_id long, cost long, good boolean, said string"
LIMITS = guards.Limits(failures=3, recovery=60, successes=2, daily_budget=400, monthly_budget=700, per_window=4, window=60, per_day=50)
START = datetime(2024, 1, 30)


def some_calls(n=900, seed=3):
    rng, rows = random.Random(seed), []
    for i in range(n):
        at = START + timedelta(seconds=rng.choice([0, 3]) + 8 * (i % 12) + 2400 * (i // 12))
        rows.append((rng.choice(["a", "a", "b"]), at + timedelta(seconds=rng.choice([0, 0, 1])), i, rng.choice([0, 5, 30, None]), rng.choice([True, True, False, None]), "clash"))
    return rows + [("a", START, 10_000 + i, 1, False, "") for i in range(4)] + [(None, START, 1, 1, True, ""), ("a", None, 2, 1, True, "")]


def plain(rows, limits, known):
    """(provider, call_id, said, before, after, at) by a loop of its own."""
    out, by = [], defaultdict(list)
    for p, ts, i, cost, good, _ in rows:
        if p is not None and ts is not None:
            by[p].append((ts, i, cost or 0, bool(good)))
    for p, calls in by.items():
        state, failed, ok, last, taken = "closed", 0, 0, None, []
        for ts, i, cost, good in sorted(calls):
            if state == "open" and (due := last + timedelta(seconds=limits.recovery)) <= ts:
                out.append((p, None, "recovery", "open", "half_open", due))
                state, ok = "half_open", 0
            today, month = [c for t, c in taken if t.date() == ts.date()], [c for t, c in taken if (t.year, t.month) == (ts.year, ts.month)]
            near = [t for t, _ in taken if (ts - t).total_seconds() < limits.window]
            said = "allowed"
            for name, over in (("daily_request_limit_exceeded", len(today) >= limits.per_day), ("rate_limit_per_minute_exceeded", len(near) >= limits.per_window), ("monthly_budget_exceeded", sum(month) + cost > limits.monthly_budget), ("daily_budget_exceeded", sum(today) + cost > limits.daily_budget), ("circuit_breaker_open", state == "open")):
                said = name if over else said
            before = state
            if said == "allowed":
                taken.append((ts, cost))
                if good and state == "half_open":
                    ok += 1
                    if ok == limits.successes:
                        state, failed = "closed", 0
                elif good:
                    failed = max(failed - 1, 0)
                else:
                    failed, last = failed + 1, ts
                    if state == "half_open" or failed >= limits.failures:
                        state = "open"
            out.append((p, i, said, before, state, ts))
        if state == "open" and last + timedelta(seconds=limits.recovery) <= known:
            out.append((p, None, "recovery", "open", "half_open", last + timedelta(seconds=limits.recovery)))
    return Counter(out)


def got(df):
    return Counter((r["provider"], r["call_id"], r["said"], r["before"], r["after"], r["at"]) for r in df.collect())


def test_guarded_table_against_a_plain_loop(spark):
    rows = some_calls()
    known = max(r[1] for r in rows if r[1]) - timedelta(minutes=1)
    found = got(guards.guarded(spark.createDataFrame(rows, CALLS).repartition(5), LIMITS))
    assert found == plain(rows, LIMITS, known)
    assert {k[2] for k in found} == {"allowed", "recovery", *guards.DENIED}


def test_guarded_stream_goes_on_after_a_restart(spark, tmp_path):
    rows = [r for r in some_calls(500, 4) if r[0] and r[1]]
    rows = sorted(rows, key=lambda r: (r[1], r[2]))
    frame = spark.createDataFrame(rows, CALLS)
    cut = [0, 60, 61, 200, 350, len(rows)]

    def put(k):  # files in order of time
        spark.createDataFrame(rows[cut[k] : cut[k + 1]], CALLS).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))

    def run():
        stream = flows.events_from(spark, f"{tmp_path}/in/part=*", frame.schema, files=1)
        with flows.keyed_state(spark):
            return flows.run_available(guards.guarded(stream, LIMITS), place=f"{tmp_path}/out")

    put(0), put(1), put(2)
    run()  # ends, and starts again from its checkpoint
    put(3), put(4)
    known = rows[-1][1] - timedelta(minutes=1)
    assert got(run()) == plain(rows, LIMITS, known)


def test_a_hot_provider_keeps_a_small_state():
    gate = guards.Gate(LIMITS)
    for i in range(20_000):
        list(gate.call(i, i * 1000, 0, True))
        assert len(gate.times) <= LIMITS.per_window


def test_guarded_empty_table(spark):
    assert guards.guarded(spark.createDataFrame([], CALLS), LIMITS).collect() == []


ROWS = "id long, v long, offset string"


def offsets(df):
    return sorted((r["offset"], r["id"]) for r in df.collect())


def test_offsets_are_dense_and_appends_happen_once(spark, tmp_path):
    place = f"{tmp_path}/log"
    make = lambda a, b: spark.createDataFrame([(i, i % 3) for i in range(a, b)], "id long, v long").repartition(4)
    log.append(make(0, 100), place, ["v", "id"], "one")
    log.append(make(0, 0), place, ["id"], "none")
    log.append(make(100, 150), place, ["id"], "two")
    log.append(make(500, 900), place, ["id"], "two")  # it has been there
    spark.createDataFrame([(7, 7)], "id long, v long").write.parquet(f"{place}/rows/append=3/part=0")  # an append that died before its commit
    want = [i for _, i in sorted((i % 3, i) for i in range(100))] + list(range(100, 150))
    assert offsets(log.replay(spark, place)) == list(enumerate(want))
    assert offsets(log.replay(spark, place, 90, 120)) == list(enumerate(want))[90:120]
    assert log.replay(spark, place, 150).count() == 0
    log.append(make(900, 910), place, ["id"], "three")
    assert offsets(log.replay(spark, place, 150)) == [(150 + k, 900 + k) for k in range(10)]


def test_repeated_and_null_rows_have_offsets_of_their_own(spark, tmp_path):
    place = f"{tmp_path}/log"
    log.append(spark.createDataFrame([(None, 1)] * 30 + [(5, None)] * 30, "id long, v long").repartition(3), place, ["id"], "x")
    rows = log.replay(spark, place).collect()
    assert sorted(r["offset"] for r in rows) == list(range(60)) and all((r["id"] is None) == (r["offset"] < 30) for r in rows)


def test_replay_reads_only_the_parts_of_its_range(spark, tmp_path):
    place = f"{tmp_path}/log"
    for k in range(6):
        log.append(spark.range(k * 100, k * 100 + 100), place, ["id"], str(k))
    found = log.replay(spark, place, 210, 290)
    assert found.count() == 80
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert any("(append#" in part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:])
    files = log._scan(spark, place, (3, 0), (4, 0)).select(F.input_file_name().alias("f")).distinct().collect()
    assert {r["f"].split("append=")[1][0] for r in files} == {"3", "4"}


def test_retention_keeps_offsets(spark, tmp_path):
    place = f"{tmp_path}/log"
    for k in range(5):
        log.append(spark.range(k * 10, k * 10 + 10), place, ["id"], str(k))
    log.trim(spark, place, 25)
    assert offsets(log.replay(spark, place)) == [(i, i) for i in range(20, 50)]
    assert not Path(place, "rows/append=2").exists() and Path(place, "rows/append=3").exists()
    log.append(spark.range(50, 53), place, ["id"], "more")
    assert offsets(log.replay(spark, place, 48)) == [(i, i) for i in range(48, 53)]


def events(spark, tmp_path, n=60, files=4):
    schema = "id long, kind string, v long"
    for k in range(files):
        spark.createDataFrame([(i, ["x", "y", None][i % 3], None if i % 10 == 0 else i) for i in range(k * n, k * n + n)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/f={k}")
    return lambda: flows.events_from(spark, f"{tmp_path}/in/f=*", spark.createDataFrame([], schema).schema, files=1)


def test_death_between_two_sinks_loses_and_repeats_nothing(spark, tmp_path, monkeypatch):
    stream, place, real, died = events(spark, tmp_path), f"{tmp_path}/out", log.message, []

    def dies(columns):
        if (Path(place) / "rows/batch=2").exists() and not died:
            died.append(True)
            raise RuntimeError("dies between the sinks")
        return real(columns)

    monkeypatch.setattr(log, "message", dies)
    error = F.when(F.col("v").isNull(), "no value").when(F.col("kind") == "y", "kind")
    with pytest.raises(StreamingQueryException):
        log.deliver(stream(), place, error, "id", "s")
    assert died and not (Path(place) / "dead/batch=2").exists()
    log.deliver(stream(), place, error, "id", "s")
    log.deliver(stream(), place, error, "id", "s")  # nothing is new
    bad = {i: "no value" if i % 10 == 0 else "kind" for i in range(240) if i % 10 == 0 or i % 3 == 1}
    assert sorted(r["id"] for r in log.delivered(spark, place).collect()) == [i for i in range(240) if i not in bad]
    letters = log.delivered(spark, place, "dead")
    assert {r["original_id"]: r["error"] for r in letters.collect()} == bad and letters.count() == len(bad)
    back = log.decoded(letters, "message", stream().schema)
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == [(i, ["x", "y", None][i % 3], None if i % 10 == 0 else i) for i in sorted(bad)]


def test_messages_keep_microseconds(spark):
    rows = spark.sql("SELECT id, CAST('2024-01-30 10:11:12.345678' AS TIMESTAMP) + make_interval(0, 0, 0, 0, 0, 0, id / 1000000) AS ts, CAST('2024-01-30 10:11:12.000001' AS TIMESTAMP_NTZ) AS plain FROM range(3) UNION ALL SELECT 3, NULL, NULL")
    back = log.decoded(rows.select(log.message(rows.columns).alias("m")), "m", rows.schema)
    assert sorted(back.collect(), key=lambda r: r["id"]) == sorted(rows.collect(), key=lambda r: r["id"])


def test_handlers_in_order_of_priority_each_row_once(spark, tmp_path):
    stream, calls = events(spark, tmp_path, files=2), []

    def sink(name):
        def write(rows, number):
            calls.append((number, name, sorted(r["id"] for r in rows.collect())))

        return write

    hs = [log.Handler("low", 1, F.lit(True), sink("low")), log.Handler("b", 9, F.col("kind") == "x", sink("b")), log.Handler("a", 9, F.col("kind") == "y", sink("a"))]
    log.dispatch(stream(), f"{tmp_path}/check", hs)
    log.dispatch(stream(), f"{tmp_path}/check", hs)
    assert [c[1] for c in calls] == ["a", "b", "low"] * 2
    for name, want in (("a", [i for i in range(120) if i % 3 == 1]), ("b", [i for i in range(120) if i % 3 == 0]), ("low", list(range(120)))):
        assert sorted(i for _, n, ids in calls if n == name for i in ids) == want


def test_pending_rows(spark, tmp_path):
    rows = spark.createDataFrame([(i, START + timedelta(seconds=i)) for i in range(100)], "id long, ts timestamp")
    assert log.pending(rows, f"{tmp_path}/nobody", "id").count() == 100
    rows.filter("id < 50").write.parquet(f"{tmp_path}/in")
    log.deliver(flows.events_from(spark, f"{tmp_path}/in", rows.schema), f"{tmp_path}/out", F.when(F.col("id") % 2 == 0, "even"), "id", "s")
    assert sorted(r["id"] for r in log.pending(rows, f"{tmp_path}/out", "id").collect()) == list(range(50, 100))
    now = F.lit(START + timedelta(seconds=100))
    assert sorted(r["id"] for r in log.pending(rows, f"{tmp_path}/out", "id", "ts", now).collect()) == list(range(50, 71))
