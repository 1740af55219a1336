"""Projections, keyed running state and window checks over the change history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import KEYS

#: Offsets of one log partition whose rows one window task sums up for an account.
CHUNK_OFFSETS = 1_000_000

_ORDER = ("topic", "partition_id", "offset_value")


def running_balance(commands: DataFrame, chunk: int = CHUNK_OFFSETS, opening: DataFrame | None = None) -> DataFrame:
    """Each command with ``resulting_balance``: the account's sum of amounts up to it, in (topic, partition, offset) order.

    One account can hold a third of all rows.  So sums run within chunks of offsets,
    and each chunk starts from the totals of the account's chunks before it, of which
    there is one row for each account and chunk.  ``opening`` has balances to start from.
    """
    parts = ["account_number", "topic", "partition_id", "__chunk"]
    chunked = commands.withColumn("__chunk", F.floor(F.col("offset_value") / F.lit(chunk)))
    totals = chunked.groupBy(*parts).agg(F.sum("amount").alias("__total"))
    before = Window.partitionBy("account_number").orderBy("topic", "partition_id", "__chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*parts, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__base"))
    if opening is not None:
        start = opening.select("account_number", F.col("balance").alias("__open"))
        base = base.join(start, "account_number", "left").withColumn("__base", F.col("__base") + F.coalesce("__open", F.lit(0))).drop("__open")
    within = Window.partitionBy(*parts).orderBy("offset_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = chunked.withColumn("__sum", F.sum("amount").over(within)).join(base, parts)
    return summed.withColumn("resulting_balance", (F.col("__base") + F.col("__sum")).cast("long")).drop("__chunk", "__sum", "__base")


def ledger_changes(commands: DataFrame, **more) -> DataFrame:
    """The change history: one change for each command."""
    return running_balance(commands, **more).select(*KEYS, "account_number", "amount", "reason", "resulting_balance")


def latest_per_account(changes: DataFrame) -> DataFrame:
    """Each account's balance after its last change: a partial maximum, so no account's rows meet."""
    last = F.max_by("resulting_balance", F.struct(*_ORDER))
    return changes.groupBy("account_number").agg(last.alias("balance"))


def balances(changes: DataFrame) -> DataFrame:
    return changes.groupBy("account_number").agg(F.sum("amount").cast("long").alias("balance"))


def balance_of(table: DataFrame, account: str) -> DataFrame:
    """One row: the account's balance, 0 if it isn't there."""
    return table.where(F.col("account_number") == account).agg(F.coalesce(F.max("balance"), F.lit(0)).cast("long").alias("balance")).select(F.lit(account).alias("account_number"), "balance")


def with_previous(changes: DataFrame, chunk: int = CHUNK_OFFSETS) -> DataFrame:
    """Changes with ``previous_balance``, that of the account's change before.

    As with the running balance, the window works on chunks of offsets; a chunk's
    first change takes the last balance of the account's nearest chunk before.
    """
    parts = ["account_number", "topic", "partition_id", "__chunk"]
    chunked = changes.withColumn("__chunk", F.floor(F.col("offset_value") / F.lit(chunk)))
    ends = chunked.groupBy(*parts).agg(F.max_by("resulting_balance", "offset_value").alias("__end"))
    order = Window.partitionBy("account_number").orderBy("topic", "partition_id", "__chunk")
    ends = ends.select(*parts, F.lag("__end").over(order).alias("__carried"))
    within = Window.partitionBy(*parts).orderBy("offset_value")
    lagged = chunked.withColumn("__lag", F.lag("resulting_balance").over(within)).join(ends, parts)
    return lagged.withColumn("previous_balance", F.coalesce("__lag", "__carried")).drop("__chunk", "__lag", "__carried")


def out_of_order(changes: DataFrame, **more) -> DataFrame:
    """Changes whose balance isn't the one before plus their amount."""
    return with_previous(changes, **more).where(F.col("resulting_balance") != F.coalesce("previous_balance", F.lit(0)) + F.col("amount"))


def sequence_ids(rows: DataFrame, carried: DataFrame | None = None, chunk: int = CHUNK_OFFSETS) -> DataFrame:
    """A gapless ``id`` from 1 in offset order of each log partition, after the largest id of ``carried`` (partition_id, max_id)."""
    parts = ["topic", "partition_id", "__chunk"]
    chunked = rows.withColumn("__chunk", F.floor(F.col("offset_value") / F.lit(chunk)))
    before = Window.partitionBy("topic", "partition_id").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = chunked.groupBy(*parts).count().select(*parts, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    if carried is not None:
        base = base.join(carried.select("partition_id", F.col("max_id").alias("__max")), "partition_id", "left").withColumn("__base", F.col("__base") + F.coalesce("__max", F.lit(0))).drop("__max")
    local = F.row_number().over(Window.partitionBy(*parts).orderBy("offset_value"))
    return chunked.withColumn("__n", local).join(base, parts).withColumn("id", (F.col("__base") + F.col("__n")).cast("long")).drop("__chunk", "__n", "__base")


def offset_gaps(rows: DataFrame, **more) -> DataFrame:
    """Rows whose offset isn't the number of rows before them in their log partition."""
    return sequence_ids(rows, **more).where(F.col("offset_value") != F.col("id") - 1).withColumn("expected_offset", F.col("id") - 1).drop("id")


def replayed(applied: DataFrame, order: str = "applied_seq", chunk: int = CHUNK_OFFSETS) -> DataFrame:
    """Applied records whose offset isn't above every offset applied before in their log partition.

    The largest offset so far runs within chunks of ``order`` and starts from the largest of the chunks before.
    """
    parts = ["topic", "partition_id", "__chunk"]
    chunked = applied.withColumn("__chunk", F.floor(F.col(order) / F.lit(chunk)))
    tops = chunked.groupBy(*parts).agg(F.max("offset_value").alias("__top"))
    earlier = Window.partitionBy("topic", "partition_id").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*parts, F.max("__top").over(earlier).alias("__carried"))
    before = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    most = chunked.withColumn("__most", F.max("offset_value").over(before)).join(carried, parts)
    return most.where(F.col("offset_value") <= F.greatest("__most", "__carried")).drop("__most", "__carried", "__chunk")


def max_id(numbered: DataFrame) -> DataFrame:
    return numbered.groupBy("partition_id").agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("max_id"))


def slice_sizes(rows: DataFrame, batch: Column) -> DataFrame:
    """Rows of each poll that each log partition got, with the slice's first and last offset."""
    return rows.groupBy(batch.alias("poll"), "topic", "partition_id").agg(F.count(F.lit(1)).alias("rows"), F.min("offset_value").alias("first_offset"), F.max("offset_value").alias("last_offset"))


def partition_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("topic", "partition_id").agg((F.max("offset_value") + 1).alias("size"))
