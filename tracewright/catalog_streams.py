"""Streams with state and recovery: guards of calls, the event log, deliveries and dead letters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright.lineage import shared_folder
from tracewright.registry import query, source
from tracewright.streaming import flows, guards, log

E = source("events")

#: Events as calls: twenty providers, duration as cost, errors and long ones as failures.
LIMITS = guards.Limits(recovery=7200, daily_budget=900, monthly_budget=9_000, per_window=5, window=3600, per_day=16)


def calls(events: DataFrame) -> DataFrame:
    provider = F.concat(F.lit("P"), F.pmod("user_id", F.lit(20)).cast("string"))
    return events.select(provider.alias("provider"), "ts", F.col("event_id").alias("call_id"), F.floor("value").cast("long").alias("cost"), ((F.col("event_type") != "error") & (F.col("value") <= 40)).alias("good"))


def _stream(s: SparkSession, d: str) -> DataFrame:
    return flows.events_from(s, f"{d}/events.parquet*", E(s, d).schema)


_FOLD = f"""WITH RECURSIVE c AS (SELECT 'P' || (user_id % 20) AS provider, epoch_us(ts) AS us, event_id AS call_id, CAST(floor(value) AS BIGINT) AS cost, event_type <> 'error' AND value <= 40 AS good FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY us, call_id) AS k, us // 86400000000 AS day, strftime(make_timestamp(us), '%Y-%m') AS month FROM c),
f(provider, k, call_id, us, said, before, after, failed, succeeded, last_failure, day, day_spent, day_calls, month, month_spent, times, opened) AS (
  SELECT DISTINCT provider, 0::BIGINT, NULL::BIGINT, 0::BIGINT, '', 'closed', 'closed', 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, '', 0::BIGINT, []::BIGINT[], NULL::BIGINT FROM n
  UNION ALL
  SELECT provider, k, call_id, us, said, state,
    CASE WHEN said <> 'allowed' THEN state WHEN good AND state = 'half_open' AND succeeded + 1 >= 3 THEN 'closed' WHEN good THEN state WHEN state = 'half_open' OR failed + 1 >= 5 THEN 'open' ELSE state END,
    CASE WHEN said <> 'allowed' THEN failed WHEN good AND state = 'half_open' THEN CASE WHEN succeeded + 1 >= 3 THEN 0 ELSE failed END WHEN good THEN greatest(0, failed - 1) ELSE failed + 1 END,
    CASE WHEN said <> 'allowed' THEN succeeded WHEN good AND state = 'half_open' AND succeeded + 1 < 3 THEN succeeded + 1 ELSE 0 END,
    CASE WHEN said = 'allowed' AND NOT good THEN us ELSE last_failure END, day,
    day_spent + CASE WHEN said = 'allowed' THEN cost ELSE 0 END, day_calls + CASE WHEN said = 'allowed' THEN 1 ELSE 0 END, month, month_spent + CASE WHEN said = 'allowed' THEN cost ELSE 0 END,
    CASE WHEN said = 'allowed' THEN list_append(times, us) ELSE times END, opened
  FROM (SELECT *, CASE WHEN state = 'open' THEN 'circuit_breaker_open' WHEN day_spent + cost > {LIMITS.daily_budget} THEN 'daily_budget_exceeded' WHEN month_spent + cost > {LIMITS.monthly_budget} THEN 'monthly_budget_exceeded'
      WHEN len(times) >= {LIMITS.per_window} THEN 'rate_limit_per_minute_exceeded' WHEN day_calls >= {LIMITS.per_day} THEN 'daily_request_limit_exceeded' ELSE 'allowed' END AS said
    FROM (SELECT n.*, f.failed, f.last_failure, CASE WHEN f.after = 'open' AND f.last_failure + {LIMITS.recovery}000000 <= n.us THEN 'half_open' ELSE f.after END AS state,
        CASE WHEN f.after = 'open' AND f.last_failure + {LIMITS.recovery}000000 <= n.us THEN f.last_failure + {LIMITS.recovery}000000 END AS opened, CASE WHEN f.after = 'open' THEN 0 ELSE f.succeeded END AS succeeded,
        CASE WHEN f.day = n.day THEN f.day_spent ELSE 0 END AS day_spent, CASE WHEN f.day = n.day THEN f.day_calls ELSE 0 END AS day_calls, CASE WHEN f.month = n.month THEN f.month_spent ELSE 0 END AS month_spent,
        list_filter(f.times, lambda t: n.us - t < {LIMITS.window}000000) AS times
      FROM f JOIN n ON n.provider = f.provider AND n.k = f.k + 1))),
l AS (SELECT provider, arg_max(after, k) AS state, arg_max(last_failure, k) + {LIMITS.recovery}000000 AS due FROM f GROUP BY provider)"""
_RECOVERIES = """SELECT provider, NULL AS call_id, make_timestamp(opened) AS at, 'recovery' AS said, 'open' AS before, 'half_open' AS after FROM f WHERE opened IS NOT NULL
  UNION ALL SELECT provider, NULL, make_timestamp(due), 'recovery', 'open', 'half_open' FROM l WHERE state = 'open' AND due <= (SELECT max(us) - 60000000 FROM n)"""

query("st14_admission", f"{_FOLD} SELECT provider, call_id, said FROM f WHERE k > 0")(lambda s, d: guards.guarded(calls(E(s, d)), LIMITS).filter(F.col("said") != guards.RECOVERY).select("provider", "call_id", "said"))


@query("st15_circuit_breaker", f"{_FOLD} SELECT provider, call_id, make_timestamp(us) AS at, said, before, after FROM f WHERE k > 0 AND before <> after UNION ALL {_RECOVERIES}")
def circuit_breaker(s: SparkSession, d: str) -> DataFrame:
    """The changes of all circuits, from the stream of events."""
    with flows.keyed_state(s):
        return flows.run_available(guards.guarded(calls(_stream(s, d)), LIMITS)).filter("before <> after")


def _place(s: SparkSession, name: str) -> str:
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


def _logged(s: SparkSession, d: str) -> str:
    """Events in three appends by day of the month; the second is tried twice."""
    events, place = E(s, d), _place(s, "log")
    for name, days in (("a", (1, 10)), ("b", (11, 20)), ("b", (11, 20)), ("c", (21, 31))):
        log.append(events.filter(F.dayofmonth("ts").between(*days)), place, ["ts", "event_id"], name)
    return place


_NUMBERED = "SELECT *, row_number() OVER (ORDER BY least((day(ts) - 1) // 10, 2), ts, event_id) - 1 AS n, count(*) OVER () AS total FROM events"
#: What is wrong with an event.
_ERROR = "CASE WHEN event_type = 'error' THEN 'failed' WHEN value < 2 THEN 'too small' WHEN user_id % 50 = 7 THEN 'unknown user' END"


@query("st01_event_log", f"SELECT event_id, n AS \"offset\" FROM ({_NUMBERED})")
def event_log(s: SparkSession, d: str) -> DataFrame:
    return log.replay(s, _logged(s, d)).select("event_id", "offset")


@query("st02_replay_range", f"SELECT event_id, n AS \"offset\" FROM ({_NUMBERED}) WHERE n >= total // 4 AND n < total // 2")
def replay_range(s: SparkSession, d: str) -> DataFrame:
    place, total = _logged(s, d), E(s, d).count()
    return log.replay(s, place, total // 4, total // 2).select("event_id", "offset")


@query("st03_st05_deliveries", f"SELECT event_id, 'events' AS stream, {_ERROR} AS error FROM events")
def deliveries(s: SparkSession, d: str) -> DataFrame:
    """Every event, with what is said of it if it is a dead letter."""
    place = _place(s, "deliveries")
    log.deliver(_stream(s, d), place, F.expr(_ERROR), "event_id", "events")
    good = log.delivered(s, place).select("event_id", F.lit("events").alias("stream"), F.lit(None).cast("string").alias("error"))
    return good.unionByName(log.delivered(s, place, "dead").select(F.col("original_id").alias("event_id"), "stream", "error"))


@query("st05_st08_replayed_letters", f"SELECT event_id, ts, greatest(value, 2) AS value, n AS \"offset\" FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events WHERE {_ERROR} = 'too small')")
def replayed_letters(s: SparkSession, d: str) -> DataFrame:
    """Dead letters of one kind, read from their messages, mended and appended to a log."""
    place = _place(s, "letters")
    log.deliver(_stream(s, d), place, F.expr(_ERROR), "event_id", "events")
    mended = log.decoded(log.delivered(s, place, "dead").filter("error = 'too small'"), "message", E(s, d).schema).withColumn("value", F.greatest("value", F.lit(2.0)))
    log.append(mended, f"{place}/again", ["event_id"], "again")
    return log.replay(s, f"{place}/again").select("event_id", "ts", "value", "offset")


@query("st06_st07_pending", "SELECT event_id FROM events WHERE day(ts) > 20 AND epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) >= 86400000000")
def pending_rows(s: SparkSession, d: str) -> DataFrame:
    """What a consumer that ended after the second append has left, as far as it lies for a day."""
    place, events = _logged(s, d), E(s, d)
    seen = flows.events_from(s, f"{place}/rows/append=[12]/part=*", events.withColumn("at", F.lit(0).cast("long")).schema).drop("at")
    log.deliver(seen, f"{place}/consumer", F.expr(_ERROR), "event_id", "events")
    now = events.agg(F.max("ts").cast("timestamp").alias("t")).first()["t"]
    return log.pending(log.replay(s, place), f"{place}/consumer", "event_id", "ts", F.lit(now), 86_400).select("event_id")


@query("st11_dispatch", "SELECT event_id, handler FROM events, (VALUES ('audit', 'error'), ('audit', 'purchase'), ('billing', 'purchase'), ('watch', 'error'), ('watch', 'click')) h(handler, kind) WHERE event_type = kind AND (handler <> 'watch' OR value > 50)")
def dispatched(s: SparkSession, d: str) -> DataFrame:
    """Which handler got which event, from three handlers of different priorities."""
    place = _place(s, "dispatch")
    sink = lambda name: lambda rows, n: rows.select("event_id").write.mode("overwrite").parquet(f"{place}/handled/handler={name}/batch={n}")
    kinds = {"audit": F.col("event_type").isin("error", "purchase"), "billing": F.col("event_type") == "purchase", "watch": F.col("event_type").isin("error", "click") & (F.col("value") > 50)}
    log.dispatch(_stream(s, d), f"{place}/checkpoint", [log.Handler(name, p, kinds[name], sink(name)) for name, p in (("watch", 5), ("audit", 10), ("billing", 1))])
    return s.read.parquet(f"{place}/handled").select("event_id", "handler")
