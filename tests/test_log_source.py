"""The log source, over a connector with the columns and options of the real one, and pipelines that share its partitions."""

import json
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ledgerloom.model import PipelineSpec
from ledgerloom.operators import ledger
from ledgerloom.sources import commands as source
from ledgerloom.streaming.runtime import LedgerWriter, Pipeline
from ledgerloom.streaming.store import LedgerStore

ROWS, PARTITIONS = 40, 3


def define():
    # made in a function, so that its classes travel by value

    class Slice(InputPartition):
        def __init__(self, partition, start, end):
            self.partition, self.start, self.end = partition, start, end

    def rows(topic, part):
        for n in range(part.start, part.end):
            value = json.dumps({"account_number": f"P{part.partition}-{n % 4}", "amount": n, "reason": "r"})
            yield f"P{part.partition}".encode(), value.encode(), topic, part.partition, n

    class Settings:
        def __init__(self, options):
            if "assign" in options:
                (self.topic, own), = json.loads(options["assign"]).items()
            else:
                self.topic, own = options["subscribe"], range(PARTITIONS)
            starting = options.get("startingOffsets", "latest")
            ending = options.get("endingOffsets", "latest")
            given = json.loads(starting)[self.topic] if starting.startswith("{") else {}
            self.start = {p: max(int(given.get(str(p), 0)), 0) if starting != "latest" else ROWS for p in own}
            self.end = {p: ROWS if ending == "latest" else int(json.loads(ending)[self.topic][str(p)]) for p in own}
            self.cap = int(options.get("maxOffsetsPerTrigger", 10**9))

    class Batch(DataSourceReader):
        def __init__(self, settings):
            self.settings = settings

        def partitions(self):
            return [Slice(p, self.settings.start[p], self.settings.end[p]) for p in self.settings.start]

        def read(self, part):
            yield from rows(self.settings.topic, part)

    class Stream(DataSourceStreamReader):
        def __init__(self, settings):
            self.settings, self.at = settings, None

        def initialOffset(self):
            return {str(p): o for p, o in self.settings.start.items()}

        def latestOffset(self):
            at, left = dict(self.at or self.initialOffset()), self.settings.cap
            for p in at:
                step = min(left, ROWS - at[p], self.settings.cap // len(at) or 1)
                at[p], left = at[p] + step, left - step
            self.at = at
            return at

        def partitions(self, start, end):
            self.at = end if self.at is None else self.at
            return [Slice(int(p), start[p], end[p]) for p in end if end[p] > start[p]]

        def read(self, part):
            yield from rows(self.settings.topic, part)

    class Log(DataSource):
        @classmethod
        def name(cls):
            return "standin_log"

        def schema(self):
            return "key binary, value binary, topic string, partition int, offset long"

        def reader(self, schema):
            return Batch(Settings(self.options))

        def streamReader(self, schema):
            return Stream(Settings(self.options))

    return Log


@pytest.fixture
def log(spark):
    spark.dataSource.register(define())
    return dict(servers="none:0", topic="t", connector="standin_log")


def by_partition(frame):
    return {r["partition_id"]: (r["least"], r["most"], r["n"]) for r in frame.groupBy("partition_id").agg(F.min("offset_value").alias("least"), F.max("offset_value").alias("most"), F.count("*").alias("n")).collect()}


def test_bounded_reads(spark, log):
    whole = source.log_batch(spark, **log)
    assert whole.columns == ["topic", "partition_id", "offset_value", "account_number", "amount", "reason"]
    assert by_partition(whole) == {p: (0, ROWS - 1, ROWS) for p in range(PARTITIONS)}
    assert whole.where("amount <> offset_value or account_number is null").count() == 0
    start = source.starting_offsets("t", [0, 1], {("t", 0): 9, ("t", 1): -1})
    end = json.dumps({"t": {"0": 20, "1": 5}})
    assert by_partition(source.log_batch(spark, starting=start, ending=end, partitions=[0, 1], **log)) == {0: (10, 19, 10), 1: (0, 4, 5)}
    assert source.log_batch(spark, starting="latest", **log).count() == 0


def test_a_capped_stream_delivers_all_in_small_batches(spark, log, tmp_path):
    store, sizes = LedgerStore(spark, str(tmp_path / "store")), []
    writer = LedgerWriter(store)

    def batch(frame, _):
        sizes.append(frame.count())
        writer.write(frame)

    query = source.log_stream(spark, rows_per_batch=30, **log).writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "check")).start()
    end = time.monotonic() + 120
    while sum(sizes) < ROWS * PARTITIONS and time.monotonic() < end and query.isActive:
        time.sleep(0.2)
    query.processAllAvailable()
    query.stop()
    assert max(sizes) <= 30 and sum(sizes) == ROWS * PARTITIONS
    assert store.changes().count() == ROWS * PARTITIONS and ledger.out_of_order(store.changes()).count() == 0


def test_partitions_move_between_pipelines(spark, log, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "store"))
    make = lambda name: Pipeline(PipelineSpec(name, "t"), lambda: source.log_stream(spark, **log), LedgerWriter(store), str(tmp_path / name), sleep=lambda s: None)
    one, two = make("one"), make("two")
    with pytest.raises(ValueError):
        one.revoke([0])
    one.assign([0, 1])
    one.run()
    assert by_partition(store.changes()) == {p: (0, ROWS - 1, ROWS) for p in (0, 1)}
    one.revoke([1])
    two.assign([1, 2])
    two.run()
    one.revoke([0], lost=True)
    two.assign([0])
    two.run()
    assert by_partition(store.changes()) == {p: (0, ROWS - 1, ROWS) for p in range(PARTITIONS)}
    assert (one.owned, two.owned) == (frozenset(), frozenset({0, 1, 2}))
    assert one.writer.metrics.counts["revoked"] == 1 and one.writer.metrics.counts["lost"] == 1 and two.writer.metrics.counts["assigned"] == 3
