"""Progress of streaming queries as counters and gauges, in memory and as JSON lines."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

#: What a pipeline counts.  Rows taken up, batches and changes written, records set aside, repeats, failures and fences; changes of
#: backpressure and with them of reading; rows that it refused or left to their sender; restarts; log partitions that came and went.
COUNTERS = ("enqueued", "batches", "changes", "dead_letters", "transient", "unrecoverable", "fenced", "engaged", "released", "paused", "resumed", "rejected", "ran_by_caller", "restarts", "assigned", "revoked", "lost")
#: And what it measures: rows of the last batch, and offsets between it and the end of the source.
GAUGES = ("depth", "backlog")
_OUTCOMES = {"ENGAGED": ("engaged", "paused"), "RELEASED": ("released", "resumed"), "REJECTED": ("rejected",), "RAN_BY_CALLER": ("ran_by_caller",), "QUEUED": ()}


class Metrics:
    """Counters and gauges of one pipeline, safe for threads; ``sink`` gets each change as a line of JSON."""

    def __init__(self, component: str = "unknown", sink: Callable[[str], None] | None = None):
        self.component, self.sink, self.counts, self.gauges, self._lock = component, sink, {}, {}, threading.Lock()

    def add(self, name: str, n: int = 1) -> None:
        if name not in COUNTERS:
            raise ValueError(f"no such counter: {name}")
        with self._lock:
            self.counts[name] = self.counts.get(name, 0) + n
        self._tell(name, "add", n)

    def gauge(self, name: str, value: float) -> None:
        if name not in GAUGES:
            raise ValueError(f"no such gauge: {name}")
        with self._lock:
            self.gauges[name] = value
        self._tell(name, "set", value)

    def _tell(self, name: str, what: str, value: float) -> None:
        if self.sink is not None:
            self.sink(json.dumps({"component": self.component, "metric": name, what: value}))

    def add_outcomes(self, rows: DataFrame, column: str = "edge") -> None:
        """Count edges or outcomes of backpressure: a row for each kind comes to the driver."""
        for kind, n in rows.groupBy(column).count().collect():
            for name in _OUTCOMES[kind]:
                self.add(name, n)


class CountingListener(StreamingQueryListener):
    """Counts queries, batches and rows by query name ("unknown" without one)."""

    COUNTERS = ("started", "batches", "rows", "terminated", "failed")

    def __init__(self, sink=None):
        self._lock, self.counters, self.gauges, self._names, self.sink = threading.Lock(), {}, {}, {}, sink

    def _add(self, name: str | None, counter: str, n: int = 1) -> None:
        with self._lock:
            key = (name or "unknown", counter)
            self.counters[key] = self.counters.get(key, 0) + n
            if self.sink is not None:
                self.sink(json.dumps({"component": key[0], "metric": counter, "add": n}))

    def onQueryStarted(self, event) -> None:
        self._names[str(event.id)] = event.name
        self._add(event.name, "started")

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        self._add(progress.name, "batches")
        self._add(progress.name, "rows", int(progress.numInputRows))
        with self._lock:
            self.gauges[progress.name or "unknown", "rows_per_s"] = progress.processedRowsPerSecond
            behind = [int(s.metrics["maxOffsetsBehindLatest"]) for s in progress.sources if "maxOffsetsBehindLatest" in (s.metrics or {})]
            if behind:  # the log connector's
                self.gauges[progress.name or "unknown", "backlog"] = max(behind)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self._names.get(str(event.id))
        self._add(name, "failed" if event.exception else "terminated")

    def total(self, counter: str) -> int:
        with self._lock:
            return sum(n for (_, c), n in self.counters.items() if c == counter)

    def frame(self, spark: SparkSession) -> DataFrame:
        with self._lock:
            rows = [(name, counter, n) for (name, counter), n in sorted(self.counters.items())]
        return spark.createDataFrame(rows, "component string, metric string, n long")


def minus(after: DataFrame, before: DataFrame, keys: list[str], value: str) -> DataFrame:
    """What has been added between two snapshots of counters; counters that are new count from 0."""
    from pyspark.sql import functions as F

    joined = after.select(*keys, F.col(value).alias("__after")).join(before.select(*keys, F.col(value).alias("__before")), keys, "left")
    return joined.select(*keys, (F.col("__after") - F.coalesce("__before", F.lit(0))).cast("long").alias(value))
