"""Command sources: parquet batches, file streams and a log connector, all with the same columns.

A command row has ``topic, partition_id, offset_value, account_number, amount, reason``.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import COMMAND_SCHEMA, NO_TOKEN, TOPIC

#: Rows of the input that one window task numbers at most (for each log partition).
NUMBERED_TOGETHER = 1_000_000


def numbered(frame: DataFrame, key: str, order: str, together: int = NUMBERED_TOGETHER) -> DataFrame:
    """``frame`` with ``offset_value``: 0, 1, 2, ... within ``key`` by the whole number ``order``.

    A log partition can hold a third of all rows, so none is numbered in one
    task: rows are numbered within ranges of ``order``, and each range starts where the
    counts of the ranges before end.  The counts are one row for each range and key.
    """
    ranged = frame.withColumn("__range", F.floor(F.col(order) / F.lit(together)))
    counts = ranged.groupBy(key, "__range").count()
    before = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(key, "__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    local = F.row_number().over(Window.partitionBy(key, "__range").orderBy(order))
    return ranged.withColumn("__n", local).join(base, [key, "__range"]).withColumn("offset_value", (F.col("__base") + F.col("__n") - 1).cast("long")).drop("__range", "__base", "__n")


def commands(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The command stream that ``events`` stands for: accounts stick to partitions, purchases are debits, amounts are cents."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", *more)
    placed = events.withColumn("partition_id", (F.col("user_id") % 3).cast("int"))
    cents = F.round(F.col("value") * 100).cast("long")
    return numbered(placed, "partition_id", "event_id").select(
        F.lit(TOPIC).alias("topic"),
        "partition_id",
        "offset_value",
        F.concat(F.lit("ACC-"), F.col("user_id").cast("string")).alias("account_number"),
        F.when(F.col("event_type") == "purchase", -cents).otherwise(cents).alias("amount"),
        F.col("event_type").alias("reason"),
        "value",
        *more,
    )


def decoded(frame: DataFrame, value: str = "value", schema: str = COMMAND_SCHEMA) -> DataFrame:
    """``frame`` with the JSON text in ``value`` taken apart; text that isn't JSON gives nulls."""
    return frame.withColumn("__decoded", F.from_json(F.col(value).cast("string"), schema)).select(*[c for c in frame.columns if c != value], "__decoded.*")


def file_stream(spark: SparkSession, folder: str, files_per_batch: int = 1, schema: str | None = None) -> DataFrame:
    """Commands from parquet files as they appear, with offsets already in them; a cap of files for each micro-batch."""
    return spark.readStream.schema(schema or f"topic string, partition_id int, offset_value long, {COMMAND_SCHEMA}").option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def starting_offsets(topic: str, partitions: Sequence[int], tokens: dict[tuple[str, int], int]) -> str:
    """Where the log connector starts: behind each log partition's token, at the beginning (-2) where there is none."""
    return json.dumps({topic: {str(p): tokens[topic, p] + 1 if tokens.get((topic, p), NO_TOKEN) >= 0 else -2 for p in partitions}})


def _log(reader, connector: str, servers: str, topic: str, starting: str, partitions: Sequence[int] | None):
    reader = reader.format(connector).option("kafka.bootstrap.servers", servers).option("startingOffsets", starting)
    return reader.option("subscribe", topic) if partitions is None else reader.option("assign", json.dumps({topic: list(partitions)}))


def _log_rows(rows: DataFrame) -> DataFrame:
    return decoded(rows.select("topic", F.col("partition").alias("partition_id"), F.col("offset").alias("offset_value"), "value"))


def log_stream(spark: SparkSession, servers: str, topic: str, starting: str = "earliest", rows_per_batch: int | None = None, partitions: Sequence[int] | None = None, connector: str = "kafka") -> DataFrame:
    """Commands from the log connector of Spark, which has to be on the class path: all log partitions, or those assigned here."""
    reader = _log(spark.readStream, connector, servers, topic, starting, partitions)
    if rows_per_batch:
        reader = reader.option("maxOffsetsPerTrigger", rows_per_batch)
    return _log_rows(reader.load())


def log_batch(spark: SparkSession, servers: str, topic: str, starting: str = "earliest", ending: str = "latest", partitions: Sequence[int] | None = None, connector: str = "kafka") -> DataFrame:
    """A bounded read of the log: from ``starting`` to what ``ending`` is when it begins."""
    return _log_rows(_log(spark.read, connector, servers, topic, starting, partitions).option("endingOffsets", ending).load())


def seek(frame: DataFrame, start: int | str) -> DataFrame:
    """Rows from an exact offset (0 or more), from the ``beginning``, or none: the ``end`` of what is there."""
    if start == "beginning":
        return frame
    if start == "end":
        return frame.where(F.lit(False))
    if not isinstance(start, int) or start < 0:
        raise ValueError("an offset is 0 or more, 'beginning' or 'end'")
    return frame.where(F.col("offset_value") >= start)


def encoded(commands: DataFrame, into: str = "value") -> DataFrame:
    """Keys and JSON text of commands, as the log holds them: what ``decoded`` reads back."""
    fields = [f.split()[0] for f in COMMAND_SCHEMA.split(", ")]
    rest = [c for c in commands.columns if c not in fields and c != into]
    return commands.select(*rest, F.col("account_number").alias("key"), F.to_json(F.struct(*fields)).alias(into))


def generated(spark: SparkSession, messages: int, accounts: int, shuffled: bool = False, seed: int = 42) -> DataFrame:
    """``messages`` credits of 1 dealt over ``accounts`` in turn, or the same in a seeded random order."""
    mixed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 15), 16, 10).cast("long")
    order = mixed if shuffled else F.col("id")
    return spark.range(messages).select(F.col("id").alias("message_id"), order.alias("send_order"), F.concat(F.lit("ACC-"), (F.col("id") % accounts).cast("string")).alias("account_number"), F.lit(1).cast("long").alias("amount"), F.lit("credit").alias("reason"))


def signed(spark: SparkSession, rows: list[tuple[str, int, str]], topic: str = TOPIC, partition: int = 0) -> DataFrame:
    """Hand-written commands at offsets 0, 1, 2, ... of one partition: (account, signed amount, reason)."""
    return spark.createDataFrame([(topic, partition, k, *row) for k, row in enumerate(rows)], f"topic string, partition_id int, offset_value long, {COMMAND_SCHEMA}")


def signed_load(spark: SparkSession, messages: int, accounts: int, flood_from: int) -> DataFrame:
    """Credits and debits in turn at offsets 0, 1, 2, ... of one partition, and from ``flood_from`` on a flood of credits to one account."""
    n = F.col("id")
    flood, debit = n >= flood_from, n % 2 == 1
    amount = F.when(flood, F.lit(1)).when(debit, -F.abs(n % 97 + 1)).otherwise(F.abs(n % 97 + 1))
    account = F.concat(F.lit("ACC-"), F.when(flood, F.lit(0)).otherwise(n % accounts).cast("string"))
    reason = F.when(flood, "flood").when(debit, "debit").otherwise("credit")
    return spark.range(messages).select(F.lit(TOPIC).alias("topic"), F.lit(0).alias("partition_id"), n.alias("offset_value"), account.alias("account_number"), amount.cast("long").alias("amount"), reason.alias("reason"))
