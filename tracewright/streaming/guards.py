"""Guards of calls to providers: circuit breakers, budgets and rate limits, decided call by call in order of time.

A denied call neither fills a window nor spends anything, so what becomes of a call depends on all before it: one small state for each
provider is folded over its calls. Of a table, calls are sorted within provider and stream through the fold; of a stream, the state is
kept by Spark between micro-batches (transformWithStateInPandas), and an event-time timer lets an open circuit try again when no
call comes. Both give the same rows, however the stream is cut into micro-batches of ascending time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: States of a circuit, and what is said of a call, in the order in which limits are tried.
CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"
ALLOWED = "allowed"
DENIED = ("circuit_breaker_open", "daily_budget_exceeded", "monthly_budget_exceeded", "rate_limit_per_minute_exceeded", "daily_request_limit_exceeded")
#: What is said where no call comes: the time of an open circuit is over.
RECOVERY = "recovery"
#: Of a table, a recovery behind the last call of its provider, until it is clear whether the watermark has passed it.
_PENDING = "pending"

SECOND = 1_000_000
DAY = 86_400 * SECOND


@dataclass(frozen=True)
class Limits:
    """None: no such limit. Costs and budgets are whole numbers, as cents. Times are in seconds."""

    failures: int = 5
    recovery: int = 60
    successes: int = 3
    daily_budget: int | None = None
    monthly_budget: int | None = None
    per_window: int | None = 100
    window: int = 60
    per_day: int | None = 10_000


class Gate:
    """The state of one provider. Times are microseconds of the epoch; `times` holds at most per_window of them."""

    FIELDS = ("state", "failed", "succeeded", "last_failure", "day", "day_spent", "day_calls", "month", "month_spent", "times")
    SCHEMA = "state string, failed long, succeeded long, last_failure long, day long, day_spent long, day_calls long, month long, month_spent long, times array<long>"

    def __init__(self, limits: Limits, held: tuple | None = None) -> None:
        self.limits = limits
        for name, value in zip(self.FIELDS, held or (CLOSED, 0, 0, 0, 0, 0, 0, 0, 0, []), strict=True):
            setattr(self, name, value)
        self.times = list(self.times)

    def held(self) -> tuple:
        return tuple(getattr(self, name) for name in self.FIELDS)

    def tries_at(self) -> int | None:
        """When an open circuit lets a call through again."""
        return self.last_failure + self.limits.recovery * SECOND if self.state == OPEN else None

    def recover(self, now: int) -> Iterator[tuple]:
        """A row of the change, if the time has come."""
        if (due := self.tries_at()) is not None and due <= now:
            self.state, self.succeeded = HALF_OPEN, 0
            yield None, due, RECOVERY, OPEN, HALF_OPEN

    def call(self, call_id: int, now: int, cost: int, good: bool) -> Iterator[tuple]:
        """(call, time, what is said, state before, state after); a recovery that is due comes first."""
        yield from self.recover(now)
        before, said = self.state, self._said(now, cost)
        if said == ALLOWED:
            self._record(now, cost, good)
        yield call_id, now, said, before, self.state

    def _said(self, now: int, cost: int) -> str:
        limits, day = self.limits, now // DAY
        date = datetime.fromtimestamp(now // SECOND, UTC)
        month = date.year * 12 + date.month
        if day != self.day:
            self.day, self.day_spent, self.day_calls = day, 0, 0
        if month != self.month:
            self.month, self.month_spent = month, 0
        if limits.per_window is not None:
            self.times = [t for t in self.times if now - t < limits.window * SECOND]
        tried = (
            self.state == OPEN,
            limits.daily_budget is not None and self.day_spent + cost > limits.daily_budget,
            limits.monthly_budget is not None and self.month_spent + cost > limits.monthly_budget,
            limits.per_window is not None and len(self.times) >= limits.per_window,
            limits.per_day is not None and self.day_calls >= limits.per_day,
        )
        return next((name for name, over in zip(DENIED, tried, strict=True) if over), ALLOWED)

    def _record(self, now: int, cost: int, good: bool) -> None:
        self.day_spent += cost
        self.month_spent += cost
        self.day_calls += 1
        if self.limits.per_window is not None:
            self.times.append(now)
        if good and self.state == HALF_OPEN:
            self.succeeded += 1
            if self.succeeded >= self.limits.successes:
                self.state, self.failed, self.succeeded = CLOSED, 0, 0
        elif good:
            self.failed = max(0, self.failed - 1)
        else:
            self.failed += 1
            self.last_failure = now
            if self.state == HALF_OPEN or self.failed >= self.limits.failures:
                self.state, self.succeeded = OPEN, 0


OUT = ("provider", "call_id", "us", "said", "before", "after")
CALLS = ["provider", "us", "call_id", "cost", "good"]
#: Calls of a provider that are Python objects at once; the others of a micro-batch are numbers in arrays, 25 bytes each.
CHUNK = 10_000


def _rows(provider: object, found: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame([(provider, *x) for x in found], columns=list(OUT))
    return out.astype({"call_id": "Int64", "us": "int64"})


def _columns(rows: Iterator[pd.DataFrame]) -> dict[str, np.ndarray]:
    """Number columns of all rows; the texts beside them go batch by batch."""
    kinds = {"us": np.int64, "call_id": np.int64, "cost": np.int64, "good": np.bool_}
    parts = [{c: r[c].to_numpy(dtype=k, copy=True) for c, k in kinds.items()} for r in rows]
    return {c: np.concatenate([p.pop(c) for p in parts]) for c in kinds}


class Guard(StatefulProcessor):
    """A provider's Gate between micro-batches. The rows of a provider in one micro-batch are sorted in memory, as numbers."""

    def __init__(self, limits: Limits) -> None:
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.value = handle, handle.getValueState("gate", Gate.SCHEMA)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        gate = Gate(self.limits, self.value.get() if self.value.exists() else None)
        was, calls = gate.tries_at(), _columns(rows)
        order = np.lexsort((calls["call_id"], calls["us"]))
        for start in range(0, len(order), CHUNK):
            taken, found = order[start : start + CHUNK], []
            for call_id, us, cost, good in zip(*(calls[c][taken].tolist() for c in ("call_id", "us", "cost", "good")), strict=True):
                found += gate.call(call_id, us, cost, good)
            yield _rows(key[0], found)
        self._keep(gate, was)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        gate = Gate(self.limits, self.value.get())
        found = list(gate.recover(expiredTimerInfo.getExpiryTimeInMs() * 1000))
        self._keep(gate, None)
        yield _rows(key[0], found)

    def _keep(self, gate: Gate, was: int | None) -> None:
        self.value.update(gate.held())
        if (due := gate.tries_at()) != was:
            if was is not None:
                self.handle.deleteTimer(-(-was // 1000))
            if due is not None:
                self.handle.registerTimer(-(-due // 1000))

    def close(self) -> None:
        pass


def guarded(calls: DataFrame, limits: Limits, late: str = "1 minute") -> DataFrame:
    """provider, call_id, at, said, before, after: one row for each call, and one (call_id null) for each circuit that tries again.

    calls: provider, call_id, ts, cost (whole), good; calls of one time go by call_id. A null cost is 0 and a null good a failure; rows
    without provider, time or call_id are no calls. A recovery belongs to the time at which it is due; it is known once a call or the
    watermark (the last time less `late`) has passed it, so that of one that is due later there is no row. Other columns are not read.
    Rows of a stream that come behind its watermark are late and go, as anywhere in Spark.
    """
    ts = F.col("ts").cast("timestamp")
    picked = calls.filter("provider IS NOT NULL AND ts IS NOT NULL AND call_id IS NOT NULL").select(
        "provider", ts.alias("ts"), F.unix_micros(ts).alias("us"), F.col("call_id").cast("long"), F.coalesce(F.col("cost").cast("long"), F.lit(0)).alias("cost"), F.coalesce("good", F.lit(False)).alias("good")
    )
    kind = picked.schema["provider"].dataType.simpleString()
    out = f"provider {kind}, call_id long, us long, said string, before string, after string"
    named = [F.timestamp_micros("us").alias("at"), "said", "before", "after"]
    if calls.isStreaming:
        timed = picked.withWatermark("ts", late)
        return timed.groupBy("provider").transformWithStateInPandas(Guard(limits), out, "append", "EventTime").select("provider", "call_id", *named)

    def behind(provider: object, gate: Gate | None) -> Iterator[pd.DataFrame]:
        if gate is not None and (rest := list(gate.recover(2**62))):
            yield _rows(provider, rest).assign(said=_PENDING)

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider, gate = None, None
        for part in parts:
            for name, rows in part.groupby("provider", sort=False):
                if gate is None or name != provider:
                    yield from behind(provider, gate)
                    provider, gate = name, Gate(limits)
                found = []
                for call_id, us, cost, good in zip(*(rows[c].tolist() for c in ("call_id", "us", "cost", "good")), strict=True):
                    found += gate.call(call_id, us, cost, good)
                yield _rows(provider, found)
        yield from behind(provider, gate)

    folded = picked.select(*CALLS).repartition("provider").sortWithinPartitions("provider", "us", "call_id").mapInPandas(fold, out)
    last = picked.agg((F.max("ts") - F.expr(f"INTERVAL {late}")).alias("t")).first()["t"]
    due = F.col("said") == _PENDING
    rows = folded.select("provider", "call_id", *named).filter(~due | (F.col("at") <= F.lit(last)))
    return rows.withColumn("said", F.when(due, RECOVERY).otherwise(F.col("said")))
