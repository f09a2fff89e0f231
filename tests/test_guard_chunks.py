"""A provider's calls of one micro-batch leave in chunks, as a plain loop over the sorted calls gives them."""

import random

import pandas as pd

from tracewright.streaming import guards


class Held:
    def exists(self):
        return False

    def update(self, value):
        self.value = value


class Timers:
    def registerTimer(self, ms):  # noqa: N802
        self.at = ms


def test_calls_of_one_micro_batch_in_chunks():
    rng, limits = random.Random(3), guards.Limits(recovery=5, per_window=50, window=5)
    calls = [(rng.randrange(2_000) * guards.SECOND, i, rng.randrange(9), rng.random() < 0.6) for i in range(25_000)]
    guard = guards.Guard(limits)
    guard.handle, guard.value = Timers(), Held()
    batches = (pd.DataFrame(calls[k : k + 4_000], columns=["us", "call_id", "cost", "good"]).assign(provider="P") for k in range(0, len(calls), 4_000))
    parts = list(guard.handleInputRows(("P",), batches, None))
    gate, want = guards.Gate(limits), []
    for us, call_id, cost, good in sorted(calls):
        want += gate.call(call_id, us, cost, good)
    rows = [(None if pd.isna(r.call_id) else int(r.call_id), r.us, r.said, r.before, r.after) for part in parts for r in part.itertuples()]
    assert rows == want and guard.value.value == gate.held()
    assert len(parts) == 3 and all(set(part["provider"]) == {"P"} for part in parts)
