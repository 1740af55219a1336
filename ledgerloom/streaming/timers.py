"""Processing-time timers in a stream: one-shot timers of actors, and backpressure that is looked at again without input.

Both need the RocksDB state store and a trigger that goes on (``processingTime``): the engine then runs batches without
input too, and timers fire in the first batch after they are due.  What they leave in the state store survives lost executors and restarts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..model import Watermarks

# Spark runs the processor in a process of the driver that has no files that were added to the session.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FIRED_SCHEMA = "actor string, timer_id long, outcome string, due_ms long, fired_ms long"
EDGE_SCHEMA = "topic string, partition_id int, offset_value long, depth long, edge string, source string"


class SelfTimers(StatefulProcessor):
    """Rows ``actor, timer_id, delay_ms`` set one-shot timers; a row with a null ``timer_id`` stops the actor.

    A null or negative delay is REJECTED at once; a timer that is due is FIRED, of several due at once the earliest and
    then the least id first; a stopped actor's timers are dropped, as are those it sets later.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "due_ms long, timer_id long", "set_ms long")
        self.stopped = handle.getValueState("stopped", "at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, refused = timerValues.getCurrentProcessingTimeInMs(), []
        frame = pd.concat(list(rows))
        if frame["timer_id"].isna().any():
            self.stopped.update((now,))
            self.pending.clear()
        for timer, delay in sorted((t, d) for t, d in zip(frame["timer_id"], frame["delay_ms"].fillna(-1)) if pd.notna(t)):
            if delay < 0:
                refused.append((key[0], int(timer), "REJECTED", None, now))
            elif not self.stopped.exists():
                due = now + int(delay)
                self.pending.updateValue((due, int(timer)), (now,))
                self.handle.registerTimer(due)
        if refused:
            yield _frame(refused, FIRED_SCHEMA)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        # of the actor's own timers, and each of them once: later expiries of the same batch find none
        due = sorted(k for k in ((int(d), int(t)) for d, t in self.pending.keys()) if k[0] <= expiredTimerInfo.getExpiryTimeInMs())
        for k in due:
            self.pending.removeKey(k)
        if due and not self.stopped.exists():
            yield _frame([(key[0], t, "FIRED", d, now) for d, t in due], FIRED_SCHEMA)

    def close(self) -> None:
        pass


class Backpressure(StatefulProcessor):
    """Edges of rows ``topic, partition_id, offset_value, depth``, and a look every ``every_ms`` while engaged.

    Between samples a buffer drains by ``per_second`` rows, so a release comes without input, too; its source is ``tick``.
    Samples count in the order of offsets, several of one offset in that of depths; those without a depth or an offset don't count.
    """

    def __init__(self, marks: Watermarks, every_ms: int, per_second: float):
        self.high, self.low, self.every_ms, self.per_second = marks.high, marks.low, every_ms, per_second

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "engaged boolean, offset_value long, depth long, at_ms long")

    def _again(self, now: int) -> None:
        if not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(now + self.every_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, found = timerValues.getCurrentProcessingTimeInMs(), []
        engaged = self.held.exists() and self.held.get()[0]
        frame = pd.concat(list(rows)).dropna(subset=["offset_value", "depth"]).sort_values(["offset_value", "depth"])
        for offset, depth in zip(frame["offset_value"].astype(int), frame["depth"].astype(int)):
            if depth >= self.high and not engaged or depth <= self.low and engaged:
                engaged = not engaged
                found.append((key[0], int(key[1]), offset, depth, "ENGAGED" if engaged else "RELEASED", "input"))
        if len(frame):
            self.held.update((engaged, int(frame["offset_value"].iloc[-1]), int(frame["depth"].iloc[-1]), now))
            if engaged:
                self._again(now)
        if found:
            yield _frame(found, EDGE_SCHEMA)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        engaged, offset, depth, at = self.held.get()
        if not engaged:
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        left = max(0, int(depth - self.per_second * (now - at) / 1000))
        if left <= self.low:
            self.held.update((False, offset, left, now))
            yield _frame([(key[0], int(key[1]), offset, left, "RELEASED", "tick")], EDGE_SCHEMA)
        else:
            self.handle.registerTimer(now + self.every_ms)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[field.split()[0] for field in schema.split(", ")]).astype(object)


def self_timers(requests: DataFrame) -> DataFrame:
    """Fired and rejected timers of a stream of requests, as ``actor, timer_id, outcome, due_ms, fired_ms``."""
    return requests.groupBy("actor").transformWithStateInPandas(SelfTimers(), FIRED_SCHEMA, "append", "processingTime")


def backpressure_edges(samples: DataFrame, marks: Watermarks, every_ms: int = 1_000, per_second: float = 0.0) -> DataFrame:
    """Changes of the backpressure of a stream of depths, by input and by ticks."""
    return samples.groupBy("topic", "partition_id").transformWithStateInPandas(Backpressure(marks, every_ms, per_second), EDGE_SCHEMA, "append", "processingTime")
