"""Pipelines: micro-batches of commands into a store, with retries, dead letters and side effects.

Each micro-batch is one transaction: rows above the held tokens are split into valid
ones and poison, the valid ones become changes and balances, the poison dead letters, and all
of it is committed in one version together with the tokens.  What the streaming checkpoint knows
is a hint only: replayed rows are below the tokens and drop out.

Side effects run after the commit and outside of the retries; if one fails, the batch stays
committed.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import NO_TOKEN, FencedError, PersistenceConfig, PipelineSpec, TransientError, UnrecoverableError
from ..operators import fencing, ledger, sinks
from ..sources import commands
from .metrics import Metrics
from .store import LedgerStore, Version


def retry_delay_ms(attempt: int) -> int:
    """Milliseconds before a batch is written again, attempts from 1."""
    return min(50 << min(attempt - 1, 20), 5_000)


@dataclass
class LedgerWriter:
    """Writes batches of commands to a store, one writer for each store at a time."""

    store: LedgerStore
    config: PersistenceConfig = field(default_factory=PersistenceConfig)
    violation: Column | None = None
    before_persist: Callable[[DataFrame], None] | None = None
    after_commit: Callable[[DataFrame], None] | None = None
    one_pass: bool = False
    sleep: Callable[[float], None] = time.sleep
    metrics: Metrics = field(default_factory=Metrics)
    held: Version | None = None

    def start(self) -> Version:
        """Adopt the committed version: tokens and balances are taken from it, never from memory."""
        self.held = self.store.current()
        return self.held

    def write(self, batch: DataFrame) -> Version:
        """Commit one batch; transient errors repeat it, what remains of them is unrecoverable.

        Log partitions that others have taken over drop out, the rest of the batch is committed, and
        only then does the write fail with the names of those that were lost.
        """
        held, lost = self.held or self.start(), []
        while True:
            try:
                version, fresh = self._repeated(held, batch)
                break
            except FencedError as error:
                self.metrics.add("fenced", len(error.partitions))
                lost += error.partitions
                taken = partition_rows(self.store.spark, error.partitions)
                batch = batch.join(F.broadcast(taken), ["topic", "partition_id"], "left_anti")
        self.held = version
        if fresh is not None:
            self.metrics.add("batches")
            self.held = self.store.tidy(version)
            if self.after_commit is not None:
                self.after_commit(fresh)
        if lost:
            raise FencedError(lost)
        return self.held

    def _repeated(self, held: Version, batch: DataFrame) -> tuple[Version, DataFrame | None]:
        attempt = 0
        while True:
            try:
                return self._transaction(held, batch)
            except TransientError as error:
                attempt += 1
                self.metrics.add("transient")
                if attempt > self.config.max_retries:
                    self.metrics.add("unrecoverable")
                    raise UnrecoverableError(f"gave up after {self.config.max_retries} repeats") from error
                self.sleep(retry_delay_ms(attempt) / 1000)
            except UnrecoverableError:
                self.metrics.add("unrecoverable")
                raise

    def _transaction(self, held: Version, batch: DataFrame) -> tuple[Version, DataFrame | None]:
        store, violation = self.store, self.violation if self.violation is not None else sinks.violation()
        above = batch
        if held.tokens:
            # a row for each log partition
            above = fencing.after_token(batch, F.broadcast(store.tokens(held)))
        checked = above.dropDuplicates(["topic", "partition_id", "offset_value"]).withColumn("__violation", violation)
        if self.one_pass:
            # the writer halts at a log partition's first poison record
            first = checked.where("__violation is not null").groupBy("topic", "partition_id").agg(F.min("offset_value").alias("__first"))
            checked = checked.join(F.broadcast(first), ["topic", "partition_id"], "left").where("__first is null or offset_value <= __first").drop("__first")
        staged, written = store.stage("batch", checked.select("topic", "partition_id", "offset_value", "account_number", "amount", "reason", "__violation")), []
        try:
            kept = store.spark.read.parquet(f"{store.folder}/{staged}")
            # a row for each log partition
            ends = kept.groupBy("topic", "partition_id").agg(F.max("offset_value").alias("last"), F.count_if(F.col("__violation").isNull()).alias("good"), F.count_if(F.col("__violation").isNotNull()).alias("bad")).collect()
            if not ends:
                return held, None
            good, bad = kept.where("__violation is null").drop("__violation"), kept.where("__violation is not null")
            if self.before_persist is not None:
                self.before_persist(good)
            n_good, n_bad = sum(r["good"] for r in ends), sum(r["bad"] for r in ends)

            def stage(kind: str, rows: DataFrame) -> list[str]:
                name = store.stage(kind, rows)
                written.append(name)
                return [name]

            wanted = {}
            if n_good:
                wanted = {"changes": ledger.ledger_changes(good, opening=store.balances(held, good)), "balances": ledger.balances(good)}
            if n_bad:
                wanted["dead"] = sinks.dead_letters(bad, F.col("__violation"))
            # independent jobs, so they fill each other's gaps; leaving the block waits for all of them, failed or not
            with ThreadPoolExecutor(3) as pool:
                jobs = {kind: pool.submit(stage, kind, rows) for kind, rows in wanted.items()}
            changes, balances, dead = (jobs[kind].result() if kind in jobs else [] for kind in ("changes", "balances", "dead"))
            version = store.publish(held, changes, balances, dead, {(r["topic"], r["partition_id"]): r["last"] for r in ends}, {"changes": n_good, "dead": n_bad})
        except BaseException:
            for name in written:  # no version lists them
                store.discard(name)
            raise
        finally:
            store.discard(staged)
        self.metrics.add("enqueued", n_good + n_bad)
        self.metrics.add("dead_letters", n_bad)
        self.metrics.add("changes", n_good)
        self.metrics.gauge("depth", n_good + n_bad)
        return version, store._read("changes", changes)


def partition_rows(spark: SparkSession, partitions: list[tuple[str, int]]) -> DataFrame:
    """Log partitions as rows."""
    return spark.createDataFrame(sorted(partitions), "topic string, partition_id int")


class Pipeline:
    """A running query that feeds a writer; a failed one is started again from the committed tokens.

    A pipeline handles all log partitions, or those that are assigned to it.  A change of the assignment ends
    the query and starts another from a checkpoint of its own, since rows that weren't its own are behind it in the old one; the tokens
    drop what is committed already, and fence a pipeline that still writes to a log partition it lost.
    """

    def __init__(self, spec: PipelineSpec, source: Callable[[], DataFrame], writer: LedgerWriter, checkpoint: str, max_restarts: int = 10, sleep: Callable[[float], None] = time.sleep):
        self.spec, self.source, self.writer, self.checkpoint = spec, source, writer, checkpoint
        self.writer.metrics.component = spec.name
        self.max_restarts, self.sleep, self.restarts, self.query = max_restarts, sleep, 0, None
        self.owned: frozenset[int] | None = None

    def _batch(self, frame: DataFrame, _: int) -> None:
        self.writer.write(frame if self.owned is None else frame.where(F.col("partition_id").isin(sorted(self.owned))))

    def _rebalanced(self, owned: frozenset[int], metric: str, n: int) -> None:
        running = self.running
        self.stop()
        self.owned = owned
        self.writer.metrics.add(metric, n)
        if running:
            self.start(once=False)

    def assign(self, partitions: Iterable[int]) -> None:
        """Take over more log partitions; a pipeline that had all has these alone from now on."""
        more = frozenset(partitions) - (self.owned or frozenset())
        self._rebalanced((self.owned or frozenset()) | more, "assigned", len(more))

    def revoke(self, partitions: Iterable[int], lost: bool = False) -> None:
        """Give up log partitions, before another takes them over or, if they are ``lost``, after."""
        if self.owned is None:
            raise ValueError("only assigned log partitions can be revoked")
        gone = self.owned & frozenset(partitions)
        self._rebalanced(self.owned - gone, "lost" if lost else "revoked", len(gone))

    def start(self, once: bool = True):
        """Start a query from the checkpoint; the writer takes its tokens from the store."""
        self.writer.start()
        # an assignment that comes back has missed rows in between, so its checkpoint is never taken up again within this process
        folder = self.checkpoint if self.owned is None else f"{self.checkpoint}/owned-{uuid.uuid4().hex}"
        stream = self.source().writeStream.foreachBatch(self._batch).option("checkpointLocation", folder).queryName(self.spec.name)
        self.query = (stream.trigger(availableNow=True) if once else stream).start()
        return self.query

    def run(self) -> Version:
        """Process all that is there, through restarts with growing delays."""
        while True:
            try:
                self.start().awaitTermination()
                return self.writer.held
            except Exception:
                self.restarts += 1
                self.writer.metrics.add("restarts")
                if self.restarts > self.max_restarts:
                    raise
                self.sleep(min(100 << (self.restarts - 1), 30_000) / 1000)

    @property
    def running(self) -> bool:
        return self.query is not None and self.query.isActive

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()


@dataclass(frozen=True)
class PartitionContext:
    """What a pipeline's code can ask and set for one log partition."""

    store: LedgerStore
    topic: str
    partition_id: int

    @property
    def token(self) -> int:
        """The committed token, -1 if there is none."""
        return self.store.current().tokens.get((self.topic, self.partition_id), NO_TOKEN)

    @property
    def resume_at(self) -> int | str:
        """Where reading goes on after a restart: behind the token, or at the beginning."""
        return self.token + 1 if self.token >= 0 else "beginning"

    def rows(self, frame: DataFrame) -> DataFrame:
        return frame.where((F.col("topic") == self.topic) & (F.col("partition_id") == self.partition_id))

    def seek(self, frame: DataFrame, start: int | str | None = None) -> DataFrame:
        """This log partition's rows from an offset, the beginning or the end; by default from where reading goes on."""
        return commands.seek(self.rows(frame), self.resume_at if start is None else start)


class Registry:
    """Pipelines by name; starting a name again gives the pipeline that is there."""

    def __init__(self):
        self._lock, self._pipelines = threading.Lock(), {}

    def start(self, name: str, make: Callable[[], Pipeline]) -> Pipeline:
        with self._lock:
            if name not in self._pipelines:
                pipeline = make()
                pipeline.start()  # a start that fails registers nothing
                self._pipelines[name] = pipeline
            return self._pipelines[name]

    def stop(self, name: str) -> None:
        with self._lock:
            pipeline = self._pipelines.pop(name, None)
        if pipeline is not None:
            pipeline.stop()

    def status(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(name, p.running) for name, p in sorted(self._pipelines.items())], "name string, running boolean")
