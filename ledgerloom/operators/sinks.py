"""Idempotent inserts, upserts and dead letters, as functions of the stored and the incoming rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import KEYS, REASON_LIMIT


def idempotent_insert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Incoming rows whose key isn't stored, one for each key."""
    return incoming.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")


def deltas(rows: DataFrame) -> DataFrame:
    """Sum of amounts for each account."""
    return rows.groupBy("account_number").agg(F.sum("amount").cast("long").alias("delta"))


def upsert_additive(table: DataFrame, fresh: DataFrame) -> DataFrame:
    """Balances plus the sums of newly inserted amounts; new accounts start from 0."""
    joined = table.join(deltas(fresh), "account_number", "full_outer")
    return joined.select("account_number", (F.coalesce("balance", F.lit(0)) + F.coalesce("delta", F.lit(0))).cast("long").alias("balance"))


def upsert_absolute(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Balances replaced by each account's last resulting balance."""
    last = changes.groupBy("account_number").agg(F.max_by("resulting_balance", F.struct(*KEYS)).alias("new"))
    return table.join(last, "account_number", "full_outer").select("account_number", F.coalesce("new", "balance").cast("long").alias("balance"))


def upsert_offsets(tokens: DataFrame, rows: DataFrame) -> DataFrame:
    """Offsets by log partition that never go back."""
    new = rows.groupBy("topic", "partition_id").agg(F.max("offset_value").alias("new"))
    return tokens.join(new, ["topic", "partition_id"], "full_outer").select("topic", "partition_id", F.greatest("num_offset", "new").cast("long").alias("num_offset"))


def poll_batch(changes: DataFrame, table: DataFrame, tokens: DataFrame, incoming: DataFrame) -> dict[str, DataFrame]:
    """What one transaction writes for a poll: new changes, balances by their last change, and offsets."""
    return {"changes": idempotent_insert(changes, incoming), "balances": upsert_absolute(table, incoming), "offsets": upsert_offsets(tokens, incoming)}


def insert_returning_upsert(existing: DataFrame, table: DataFrame, incoming: DataFrame) -> DataFrame:
    """Balances replaced from those incoming rows only that weren't stored before."""
    return upsert_absolute(table, idempotent_insert(existing, incoming))


def pk_violations(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keys that a plain insert would violate: stored already, or more than once in the batch."""
    keys = list(keys)
    many = incoming.groupBy(*keys).count()
    known = existing.select(*keys).distinct().withColumn("__known", F.lit(True))
    return many.join(known, keys, "left").where("count > 1 or __known").select(*keys, F.coalesce("__known", F.lit(False)).alias("stored_before"), F.col("count").alias("in_batch"))


def violation(limit: int = REASON_LIMIT) -> Column:
    """Why the store would refuse a command; null if it wouldn't."""
    return (
        F.when(F.col("account_number").isNull(), "account_number is null")
        .when(F.col("amount").isNull(), "amount is null")
        .when(F.length("account_number") > 64, "account_number is longer than 64")
        .when(F.length("reason") > limit, F.concat(F.lit("reason is longer than "), F.lit(str(limit))))
    )


def payload() -> Column:
    return F.format_string("%s amount=%d reason=%s", "account_number", "amount", "reason")


def dead_letters(pills: DataFrame, cause: Column) -> DataFrame:
    """One dead letter for each refused record, with the record as text."""
    return pills.select(*KEYS, payload().alias("payload"), F.substring(cause, 1, 512).alias("cause"))


def commit_offsets(delivered: DataFrame, slice_cols: Sequence[str] = ("topic", "partition_id")) -> DataFrame:
    """Offset after the last row, of each slice (by default all of a log partition) whose rows were all delivered."""
    whole = delivered.groupBy(*slice_cols).agg(F.bool_and("delivered").alias("whole"), (F.max("offset_value") + 1).alias("next_offset"))
    return whole.where("whole").drop("whole")


def delivered_prefix(rows: DataFrame) -> DataFrame:
    """Rows before the first refusal in their log partition: all below the least refused offset, which is a partial minimum."""
    refused = rows.where(~F.col("delivered")).groupBy("topic", "partition_id").agg(F.min("offset_value").alias("__stop"))
    # a row for each log partition at most
    return rows.join(F.broadcast(refused), ["topic", "partition_id"], "left").where("__stop is null or offset_value < __stop").drop("__stop")


def store_diff(one: DataFrame, two: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys whose values differ between two stores or that only one of them has."""
    left = one.select(*keys, F.struct(*values).alias("__one"))
    right = two.select(*keys, F.struct(*values).alias("__two"))
    joined = left.join(right, list(keys), "full_outer").where(~F.col("__one").eqNullSafe(F.col("__two")))
    return joined.select(*keys, *[F.col(f"__one.{v}").alias(f"{v}_one") for v in values], *[F.col(f"__two.{v}").alias(f"{v}_two") for v in values])


def first_batch(rows: DataFrame, size: int, order: Sequence[str] = KEYS) -> DataFrame:
    """The first ``size`` rows of the queue: each task sends its first ones only."""
    return rows.orderBy(*order).limit(size)
