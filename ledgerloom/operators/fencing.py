"""Fencing tokens: stored offsets, compare-and-set outcomes, replay and ownership filters.

Tables with a row for each log partition are broadcast, so that the stream, whose log partitions are few and hot keys, isn't shuffled by them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import NO_TOKEN

PARTITION = ("topic", "partition_id")


def stored_offset(tokens: DataFrame, topic: str, partition: int) -> DataFrame:
    """One row: the stored token of a log partition, -1 if there is none."""
    mine = tokens.where((F.col("topic") == topic) & (F.col("partition_id") == partition))
    return mine.agg(F.coalesce(F.max("num_offset"), F.lit(NO_TOKEN)).cast("long").alias("num_offset")).select(F.lit(topic).alias("topic"), F.lit(partition).alias("partition_id"), "num_offset")


def fence_outcome(attempts: DataFrame) -> DataFrame:
    """Outcome and token after each attempt of ``held_token, new_max, stored``.

    Without a held token the first one is inserted, unless one is stored; a batch that
    isn't above the held token changes nothing; otherwise the stored token must be the held
    one.  What fails is FENCED: somebody else writes this log partition.
    """
    held, new, stored = F.col("held_token"), F.col("new_max"), F.col("stored")
    outcome = F.when(held < 0, F.when(stored.isNull(), "INSERTED").otherwise("FENCED")).when(new <= held, "NOOP").when(stored.eqNullSafe(held), "ADVANCED").otherwise("FENCED")
    return attempts.withColumn("outcome", outcome).withColumn("token_after", F.when(F.col("outcome").isin("INSERTED", "ADVANCED"), new).otherwise(stored).cast("long"))


def after_token(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rows above their log partition's committed token; all rows where there is none."""
    return rows.join(F.broadcast(tokens.select(*PARTITION, "num_offset")), list(PARTITION), "left").where(F.col("offset_value") > F.coalesce("num_offset", F.lit(NO_TOKEN))).drop("num_offset")


def until_rewound(polled: DataFrame, rewinds: DataFrame) -> DataFrame:
    """Polled rows that a pending rewind discards: those polled after the request and before the seek took place.

    ``polled`` has ``poll`` numbers, ``rewinds`` one row for each rewind: ``topic, partition_id, from_poll, seek_poll``.
    """
    pending = polled.join(F.broadcast(rewinds), list(PARTITION)).where((F.col("poll") >= F.col("from_poll")) & (F.col("poll") < F.col("seek_poll")))
    return pending.select(*polled.columns).distinct()


def owned_only(rows: DataFrame, assignment: DataFrame) -> DataFrame:
    """Rows of the log partitions that are assigned here."""
    return rows.join(F.broadcast(assignment.select(*PARTITION).distinct()), list(PARTITION), "left_semi")


def current_assignment(log: DataFrame) -> DataFrame:
    """The owner of each log partition after its last event; none after a revocation or loss."""
    last = log.groupBy(*PARTITION).agg(F.max_by(F.struct("owner", "event"), "event_seq").alias("last"))
    return last.where("last.event = 'assigned'").select(*PARTITION, "last.owner")
