"""Poison records: what one pass leaves behind, and what is reached by replaying after each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTITION = ("topic", "partition_id")


def first_failures(rows: DataFrame, failed: Column) -> DataFrame:
    """The first failing offset of each log partition: a partial minimum, one row for each."""
    return rows.where(failed).groupBy(*PARTITION).agg(F.min("offset_value").alias("first_failure"))


def one_pass(rows: DataFrame, poison: Column, transient: Column | None = None) -> DataFrame:
    """``outcome`` of each row when the writer halts at its log partition's first failure.

    Rows before it are PERSISTED, a poison record there is DEAD, a transient
    failure is HALTED and never dead; what comes after is ABANDONED until a restart.
    """
    failed = poison if transient is None else poison | transient
    joined = rows.join(F.broadcast(first_failures(rows, failed)), list(PARTITION), "left")  # a row for each log partition
    at = F.when(poison if transient is None else poison & ~transient, "DEAD").otherwise("HALTED")
    outcome = F.when(F.col("first_failure").isNull() | (F.col("offset_value") < F.col("first_failure")), "PERSISTED").when(F.col("offset_value") == F.col("first_failure"), at).otherwise("ABANDONED")
    return joined.withColumn("outcome", outcome).drop("first_failure")


def converged(rows: DataFrame, poison: Column) -> DataFrame:
    """``outcome`` of each row once replays have passed all poison: DEAD or PERSISTED."""
    return rows.withColumn("outcome", F.when(poison, "DEAD").otherwise("PERSISTED"))


def summary(outcomes: DataFrame) -> DataFrame:
    """For each log partition: rows written and dead, halts (one for each pill) and the token in the end."""
    dead = F.count_if(F.col("outcome") == "DEAD")
    return outcomes.groupBy(*PARTITION).agg(F.count_if(F.col("outcome") == "PERSISTED").alias("persisted"), dead.alias("dead"), dead.alias("halts"), F.max("offset_value").alias("token"))


def split(rows: DataFrame, violation: Column) -> DataFrame:
    """Rows with ``violation`` and ``valid``: the checks that a store's constraints would make."""
    return rows.withColumn("violation", violation).withColumn("valid", F.col("violation").isNull())

