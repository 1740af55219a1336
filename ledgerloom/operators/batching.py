"""Batches, percentiles, restarts, timers, side effects, metrics and reports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import KEYS

PARTITION = ("topic", "partition_id")
#: Parts of a group's range of values whose running sums are made apart.
SLICES = 1000


def saturated_batch(size: int) -> Column:
    """The batch of an offset when the writer always finds a full buffer."""
    return F.floor(F.col("offset_value") / F.lit(size)).cast("long")


def batches(rows: DataFrame, size: int) -> DataFrame:
    """Each saturated batch with its rows and its token, the largest offset."""
    return rows.groupBy(*PARTITION, saturated_batch(size).alias("batch")).agg(F.count(F.lit(1)).alias("rows"), F.max("offset_value").alias("batch_max_offset"))


def ranked(values: DataFrame, value: str, groups: Sequence[str], indexes: dict[str, Column]) -> DataFrame:
    """For each group the values at zero-based ``indexes`` of its sorted values; an index is an expression of ``n``, the group's size.

    Values are counted first; the rank that is searched is found among running sums of
    distinct values, so that a group's repeated values never meet one by one.  A group's range is cut into ``SLICES``
    slices, and the sums run within slices, from those of the slices before: no window holds all values of a large group.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("__times"))
    sized = counted.groupBy(*groups).agg(F.sum("__times").alias("n"), F.min(value).cast("double").alias("__low"), F.max(value).cast("double").alias("__high"))
    # a row for each group
    with_size = counted.join(sized, list(groups)) if groups else counted.crossJoin(F.broadcast(sized))
    place = F.when(F.col("__high") > F.col("__low"), F.floor((F.col(value).cast("double") - F.col("__low")) / (F.col("__high") - F.col("__low")) * SLICES)).otherwise(0)
    sliced = with_size.withColumn("__slice", place.cast("long"))
    parts = [*groups, "__slice"]
    earlier = Window.partitionBy(*groups).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # SLICES + 1 rows a group
    heads = sliced.groupBy(*parts).agg(F.sum("__times").alias("__all")).select(*parts, F.coalesce(F.sum("__all").over(earlier), F.lit(0)).alias("__before"))
    upto = Window.partitionBy(*parts).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    joined = sliced.withColumn("__within", F.sum("__times").over(upto)).join(heads, parts).withColumn("__upto", F.col("__before") + F.col("__within"))
    picked = [F.min(F.when(F.col("__upto") > F.least(index, F.col("n") - 1), F.col(value))).alias(name) for name, index in indexes.items()]
    return joined.groupBy(*groups).agg(F.first("n").alias("n"), *picked)


def upper_median(values: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    return ranked(values, value, groups, {"upper_median": F.floor(F.col("n") / 2)}).drop("n")


def percentiles(values: DataFrame, value: str, groups: Sequence[str], shares: dict[str, str]) -> DataFrame:
    """Values at int(n * p) of the sorted values, p as decimal text; from p = 1 on the largest."""
    return ranked(values, value, groups, {name: F.floor(F.col("n") * F.lit(p).cast("decimal(5,4)")) for name, p in shares.items()})


def phase_shares(phases: DataFrame, partitions: int, wall: int) -> DataFrame:
    """Milliseconds of each phase for one of ``partitions`` writers, and per mille of the wall time."""
    total = phases.groupBy("approach", "phase").agg(F.sum("millis").cast("long").alias("total"))
    per_writer = F.expr(f"total div {int(partitions)}")
    return total.select("approach", "phase", per_writer.alias("per_writer_ms"), F.expr(f"(total div {int(partitions)}) * 1000 div {max(1, int(wall))}").alias("per_mille"))


def metric_counts(events: DataFrame, component: str = "component", metric: str = "metric") -> DataFrame:
    """Counts of each metric by component ("unknown" if null) and over all components ("total")."""
    each = events.groupBy(F.coalesce(F.col(component), F.lit("unknown")).alias("component"), F.col(metric).alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    total = each.groupBy("metric").agg(F.sum("n").cast("long").alias("n")).select(F.lit("total").alias("component"), "metric", "n")
    return each.unionByName(total)


def fire_timers(timers: DataFrame, stopped: DataFrame) -> DataFrame:
    """One-shot timers in the order in which they fire; those of an actor that has stopped by then are dropped."""
    if timers.where("delay_ms < 0").limit(1).count():
        raise ValueError("a delay is 0 or more")
    due = timers.withColumn("due_ms", F.col("set_at_ms") + F.col("delay_ms")).join(stopped, "actor", "left").where("stopped_at_ms is null or due_ms < stopped_at_ms").drop("stopped_at_ms")
    return due.withColumn("fire_order", F.row_number().over(Window.partitionBy("actor").orderBy("due_ms", "set_at_ms", "timer_id")).cast("long"))


def live_restarts(timers: DataFrame) -> DataFrame:
    """Restart timers by whether they are acted on: only that of the partition's latest generation is."""
    latest = timers.groupBy(*PARTITION).agg(F.max("generation").alias("__latest"))
    return timers.join(latest, list(PARTITION)).withColumn("stale", F.col("generation") < F.col("__latest")).drop("__latest")


_RAMP = "topic string, partition_id int, requested_at_ms long, delay_ms long"


def restart_delays(requests: DataFrame, base: int = 100, cap: int = 30_000) -> DataFrame:
    """Delay of each restart request: doubled each time, begun anew at the cap and after more than ``cap`` ms without a request.

    The ramp depends on all earlier requests of the log partition; restarts of one log
    partition are at least the delays apart, so a partition has few.
    """

    def ramp(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, steps, last = None, 0, 0
        for frame in frames:
            delays = []
            for topic, partition, at in zip(frame["topic"], frame["partition_id"], frame["requested_at_ms"]):
                if (topic, partition) != key:
                    key, steps, last = (topic, partition), 0, 0
                if last and at - last > cap:
                    steps = 0
                delay = min(base << min(steps, 30), cap)
                steps = 0 if delay >= cap else steps + 1
                last = at
                delays.append(delay)
            yield frame.assign(delay_ms=delays)

    ordered = requests.select(*PARTITION, F.col("requested_at_ms").cast("long")).repartition(*PARTITION).sortWithinPartitions(*PARTITION, "requested_at_ms")
    return ordered.mapInPandas(ramp, _RAMP)


RESTART_STEPS = ("pause", "begin_rewind", "stop", "wait", "start", "resume")


def restart_trace(requests: DataFrame) -> DataFrame:
    """The steps of each restart, in order, with the times at which they are due."""
    delayed = restart_delays(requests)
    steps = F.array(*[F.struct(F.lit(k).alias("step_no"), F.lit(s).alias("step")) for k, s in enumerate(RESTART_STEPS)])
    exploded = delayed.withColumn("x", F.explode(steps))
    due = F.col("requested_at_ms") + F.when(F.col("x.step_no") > RESTART_STEPS.index("wait"), F.col("delay_ms")).otherwise(0)
    return exploded.select(*PARTITION, "requested_at_ms", "x.step_no", "x.step", due.alias("due_ms"))


def side_effects(committed: DataFrame, effects: str = "side_effects") -> DataFrame:
    """Side effects of committed rows, in offset order and each row's own order: ``effect_no`` within the row."""
    return committed.select(*KEYS, F.posexplode(effects).alias("effect_no", "effect"))


def healthy(status: DataFrame) -> DataFrame:
    """One row: DOWN if a container isn't running; none at all are UP."""
    return status.agg(F.when(F.coalesce(F.bool_and("running"), F.lit(True)), "UP").otherwise("DOWN").alias("status"), F.count(F.lit(1)).alias("containers"), F.count_if(~F.col("running")).alias("not_running"))


def run_report(runs: DataFrame) -> DataFrame:
    """Throughput of each run, by round and approach."""
    return runs.select("round", "approach", "rows", "wall_ms", F.expr("rows * 1000 div greatest(1, wall_ms)").alias("rows_per_s")).orderBy("round", "approach")
