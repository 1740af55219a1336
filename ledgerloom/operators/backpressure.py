"""Hysteresis backpressure over series of buffer depths.

A depth of ``high`` or more engages, one of ``low`` or less releases, anything between
keeps the state.  Depths are rows ``topic, partition_id, offset_value, depth``; state is kept for each log partition.
A log partition can hold a third of all rows: state runs within chunks of offsets,
and each chunk starts from the last mark of the chunks before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Watermarks

PARTITION = ("topic", "partition_id")
CHUNK_OFFSETS = 1_000_000


def with_state(samples: DataFrame, marks: Watermarks, order: str = "offset_value", chunk: int = CHUNK_OFFSETS) -> DataFrame:
    """Samples with ``engaged`` after each and ``was_engaged`` before it."""
    parts = [*PARTITION, "__chunk"]
    mark = F.when(F.col("depth") >= marks.high, 1).when(F.col("depth") <= marks.low, 0)
    marked = samples.withColumn("__mark", mark).withColumn("__chunk", F.floor(F.col(order) / F.lit(chunk)))
    ends = marked.groupBy(*parts).agg(F.max_by("__mark", F.when(F.col("__mark").isNotNull(), F.col(order))).alias("__end"))
    earlier = Window.partitionBy(*PARTITION).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*parts, F.coalesce(F.last("__end", ignorenulls=True).over(earlier), F.lit(0)).alias("__carried"))
    within = Window.partitionBy(*parts).orderBy(order)
    now = F.last("__mark", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))
    before = F.last("__mark", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1))
    stated = marked.withColumn("__now", now).withColumn("__before", before).join(carried, parts)
    engaged = F.coalesce("__now", "__carried") == 1
    return stated.withColumn("engaged", engaged).withColumn("was_engaged", F.coalesce("__before", "__carried") == 1).drop("__mark", "__chunk", "__now", "__before", "__carried")


def edges(samples: DataFrame, marks: Watermarks, order: str = "offset_value", **more) -> DataFrame:
    """Each change of state once, as ENGAGED or RELEASED."""
    changed = with_state(samples, marks, order, **more).where("engaged <> was_engaged")
    return changed.withColumn("edge", F.when(F.col("engaged"), "ENGAGED").otherwise("RELEASED")).drop("engaged", "was_engaged")


def with_ticks(samples: DataFrame, drained) -> DataFrame:
    """Samples at even ``sample_seq``, and after each one of the periodic evaluator, with the depth that is left by then."""
    on_input = samples.withColumn("sample_seq", F.col("offset_value") * 2).withColumn("source", F.lit("input"))
    on_tick = samples.withColumn("depth", drained).withColumn("sample_seq", F.col("offset_value") * 2 + 1).withColumn("source", F.lit("tick"))
    return on_input.unionByName(on_tick)


def with_clear(samples: DataFrame) -> DataFrame:
    """Samples, and for each log partition a last one of depth 0: its buffer is cleared."""
    last = samples.groupBy(*PARTITION).agg((F.max("offset_value") + 1).alias("offset_value")).withColumn("depth", F.lit(0))
    return samples.select(*PARTITION, "offset_value", "depth").unionByName(last.select(*PARTITION, "offset_value", "depth"))


def rejected(samples: DataFrame, marks: Watermarks, **more) -> DataFrame:
    """Rows that come while backpressure is engaged, which the THROW strategy refuses."""
    return with_state(samples, marks, **more).where("was_engaged").drop("engaged", "was_engaged")


def admitted(samples: DataFrame, marks: Watermarks, strategy: str = "THROW", **more) -> DataFrame:
    """Each row with its ``outcome``: QUEUED, or while backpressure is engaged what the strategy does with it.

    THROW refuses it (REJECTED); CALLER_RUNS has it done by who brings it (RAN_BY_CALLER), so it's late but not lost.
    """
    engaged = {"THROW": "REJECTED", "CALLER_RUNS": "RAN_BY_CALLER"}[strategy]
    return with_state(samples, marks, **more).withColumn("outcome", F.when(F.col("was_engaged"), engaged).otherwise("QUEUED")).drop("engaged", "was_engaged")


def pauses(samples: DataFrame, marks: Watermarks, **more) -> DataFrame:
    """For each engagement where it began and where it was released; null if it never was."""
    turned = edges(samples, marks, **more)
    # edges alternate, so the release of an engagement is the next edge of its log partition
    ahead = F.lead("offset_value").over(Window.partitionBy(*PARTITION).orderBy("offset_value"))
    return turned.withColumn("resumed_at", ahead).where("edge = 'ENGAGED'").select(*PARTITION, F.col("offset_value").alias("paused_at"), "resumed_at")
