"""Store, writer and streams: exactly-once through failures, rival writers and replays."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.model import FencedError, PersistenceConfig, PipelineSpec, TransientError, UnrecoverableError
from ledgerloom.operators import ledger
from ledgerloom.plans.queries import QUERIES
from ledgerloom.sources import commands as source
from ledgerloom.streaming import metrics, state
from ledgerloom.streaming.runtime import LedgerWriter, PartitionContext, Pipeline, Registry
from ledgerloom.streaming.store import LedgerStore

PILL = "x" * 306
POISON = [("A", 100, ""), ("A", 100, ""), ("A", 100, ""), ("A", -20, ""), ("A", -30, ""), ("A", 999, PILL), ("A", 500, ""), ("A", -40, ""), ("A", -60, ""), ("A", 50, "")]
NO_SLEEP = dict(sleep=lambda s: None)


@pytest.fixture
def store(spark, tmp_path):
    return LedgerStore(spark, str(tmp_path / "store"))


def balances(store):
    return {r["account_number"]: r["balance"] for r in store.balances().collect()}


def test_poison_is_dead_lettered_and_the_rest_converges(spark, store):
    done = []
    writer = LedgerWriter(store, after_commit=lambda rows: done.extend(r["offset_value"] for r in rows.orderBy("offset_value").collect()))
    writer.write(source.signed(spark, POISON))
    assert (store.changes().count(), balances(store), store.dead().count()) == (9, {"A": 700}, 1)
    assert store.current().tokens == {("ledger-events", 0): 9} and done == [0, 1, 2, 3, 4, 6, 7, 8, 9]
    letter = store.dead().first()
    assert letter["payload"].startswith("A amount=999 reason=xxx") and "256" in letter["cause"]


def test_one_pass_halts_at_the_pill_and_goes_on_after_it(spark, store):
    writer = LedgerWriter(store, one_pass=True)
    rows = source.signed(spark, [("A", 1, "before"), ("A", 1, PILL), ("A", 1, "after")])
    writer.write(rows)
    assert (store.changes().count(), store.dead().count(), list(store.current().tokens.values())) == (1, 1, [1])
    writer.write(rows)
    assert (store.changes().count(), store.dead().count(), list(store.current().tokens.values())) == (2, 1, [2])


def test_replays_change_nothing(spark, store):
    writer, rows = LedgerWriter(store), source.signed(spark, [("A", 1, "")] * 5)
    first = writer.write(rows.where("offset_value < 3"))
    assert writer.write(rows.where("offset_value < 3")).number == first.number
    writer.write(rows)
    assert (store.changes().count(), balances(store)) == (5, {"A": 5})
    assert ledger.out_of_order(store.changes()).count() == 0
    compact = store.compact(store.current())
    assert len(compact.changes) == 1 and store.changes().count() == 5


def test_transient_errors_are_repeated_then_unrecoverable(spark, store):
    failures, delays = [2], []

    def hook(_):
        if failures[0]:
            failures[0] -= 1
            raise TransientError

    writer = LedgerWriter(store, PersistenceConfig(max_retries=3), before_persist=hook, sleep=delays.append)
    writer.write(source.signed(spark, [("A", 1, "")]))
    assert (balances(store), delays) == ({"A": 1}, [0.05, 0.1])
    failures[0] = 99
    with pytest.raises(UnrecoverableError):
        writer.write(source.signed(spark, [("A", 1, "")] * 2))
    assert balances(store) == {"A": 1}


def test_partition_context(spark, store):
    rows, context = source.signed(spark, [("A", 1, "")] * 4), PartitionContext(store, "ledger-events", 0)
    assert (context.token, context.resume_at, context.seek(rows).count()) == (-1, "beginning", 4)
    LedgerWriter(store).write(rows.where("offset_value < 3"))
    assert (context.token, context.resume_at, context.seek(rows).count()) == (2, 3, 1)
    assert [context.seek(rows, x).count() for x in (1, "end", "beginning")] == [3, 0, 4]
    assert PartitionContext(store, "ledger-events", 1).seek(rows).count() == 0


def test_a_stopped_query_loses_nothing(spark, store, tmp_path):
    write_slices(spark, str(tmp_path / "in"))
    make = lambda: Pipeline(PipelineSpec("stopped", "t"), lambda: source.file_stream(spark, str(tmp_path / "in")), LedgerWriter(store), str(tmp_path / "check"), **NO_SLEEP)
    first = make()
    first.start(once=False)
    while not store.current().number:
        first.query.awaitTermination(1)
    first.stop()
    assert not first.running
    make().run()
    assert (store.changes().count(), balances(store)) == (120, {"A0": 120, "A1": 120})


def test_zombies_are_fenced(spark, store):
    old, new = LedgerWriter(store), LedgerWriter(store)
    rows = source.signed(spark, [("A", 1, "")] * 3)
    old.start()
    new.start()
    new.write(rows.where("offset_value < 2"))
    with pytest.raises(UnrecoverableError):
        old.write(rows)
    assert balances(store) == {"A": 2}
    old.start()
    old.write(rows)
    assert balances(store) == {"A": 3}


def test_of_racing_writers_one_commits(spark, store):
    rows = source.signed(spark, [("A", 1, "")])
    results, gate = [], threading.Barrier(4)
    held = store.current()

    def run():
        name = store.stage("changes", ledger.ledger_changes(rows))
        gate.wait()
        try:
            store.publish(held, [name], tokens={("ledger-events", 0): 0})
            results.append("committed")
        except UnrecoverableError:
            results.append("fenced")

    threads = [threading.Thread(target=run) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(results) == ["committed", "fenced", "fenced", "fenced"] and store.changes().count() == 1


def test_side_effects_run_after_the_commit_only(spark, store):
    seen = []

    def boom(_):
        raise RuntimeError("side effect")

    LedgerWriter(store, after_commit=lambda rows: seen.append(store.current().number)).write(source.signed(spark, [("A", 1, "")]))
    assert seen == [1]
    with pytest.raises(RuntimeError):
        LedgerWriter(store, after_commit=boom).write(source.signed(spark, [("A", 1, "")] * 2))
    assert balances(store) == {"A": 2}


def write_slices(spark, folder, partitions=2, n=60, files=4):
    rows = spark.range(n * partitions).select(F.lit("t").alias("topic"), (F.col("id") % partitions).cast("int").alias("partition_id"), F.floor(F.col("id") / partitions).alias("offset_value"), F.concat(F.lit("A"), (F.col("id") % partitions).cast("string")).alias("account_number"), F.lit(2).cast("long").alias("amount"), F.lit("").alias("reason"))
    for k in range(files):
        step = n // files
        rows.where(f"offset_value >= {k * step} and offset_value < {(k + 1) * step}").coalesce(1).write.mode("append").parquet(folder)


def test_pipeline_restarts_and_rewinds(spark, store, tmp_path):
    write_slices(spark, str(tmp_path / "in"))
    failures = [1]

    def hook(rows):
        if failures[0] and rows.where("partition_id = 0 and offset_value > 20").limit(1).count():
            failures[0] -= 1
            raise UnrecoverableError("injected")

    writer = LedgerWriter(store, before_persist=hook)
    pipeline = Pipeline(PipelineSpec("rewind", "t"), lambda: source.file_stream(spark, str(tmp_path / "in")), writer, str(tmp_path / "check"), **NO_SLEEP)
    pipeline.run()
    assert (pipeline.restarts, store.changes().count(), balances(store)) == (1, 120, {"A0": 120, "A1": 120})
    assert ledger.offset_gaps(store.changes()).count() == 0 and len(store.history()) == 4
    # a lost checkpoint replays everything, and the tokens drop it
    again = Pipeline(PipelineSpec("rewind2", "t"), lambda: source.file_stream(spark, str(tmp_path / "in")), LedgerWriter(store), str(tmp_path / "check2"), **NO_SLEEP)
    again.run()
    assert store.changes().count() == 120


def test_registry_starts_a_name_once(spark, store, tmp_path):
    write_slices(spark, str(tmp_path / "in"), files=1)
    made = []

    def make():
        made.append(1)
        return Pipeline(PipelineSpec("one", "t"), lambda: source.file_stream(spark, str(tmp_path / "in")), LedgerWriter(store), str(tmp_path / "check"))

    registry = Registry()
    one = registry.start("one", make)
    assert registry.start("one", make) is one and len(made) == 1
    one.query.awaitTermination()
    assert registry.status(spark).count() == 1
    registry.stop("one")
    assert registry.status(spark).count() == 0


def test_state_processor_equals_the_window(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.STATE_STORE)
    listener = metrics.CountingListener()
    spark.streams.addListener(listener)
    write_slices(spark, str(tmp_path / "in"))
    write_slices(spark, str(tmp_path / "in"), files=1)  # replayed rows drop out
    stream = state.stream_ledger(source.file_stream(spark, str(tmp_path / "in")))
    stream.writeStream.format("parquet").queryName("ledger").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "in")).dropDuplicates(["topic", "partition_id", "offset_value"])
    expected = ledger.ledger_changes(rows)
    assert out.count() == 120 and out.exceptAll(expected.select(out.columns)).count() == 0
    spark.streams.removeListener(listener)
    assert listener.total("started") == 1


def test_metrics_count_what_a_pipeline_does(spark, store):
    lines = []
    writer = LedgerWriter(store, metrics=metrics.Metrics("one", lines.append))
    writer.write(source.signed(spark, POISON))
    edges = spark.createDataFrame([("ENGAGED",), ("RELEASED",), ("ENGAGED",)], "edge string")
    writer.metrics.add_outcomes(edges)
    writer.metrics.add_outcomes(spark.createDataFrame([("QUEUED",), ("REJECTED",), ("RAN_BY_CALLER",), ("REJECTED",)], "outcome string"), "outcome")
    assert writer.metrics.counts == {"enqueued": 10, "batches": 1, "changes": 9, "dead_letters": 1, "engaged": 2, "paused": 2, "released": 1, "resumed": 1, "rejected": 2, "ran_by_caller": 1}
    assert writer.metrics.gauges == {"depth": 10} and '{"component": "one", "metric": "changes", "add": 9}' in lines
    with pytest.raises(ValueError):
        writer.metrics.add("nonsense")
    with pytest.raises(ValueError):
        writer.metrics.gauge("nonsense", 1)


def test_registered_queries_run(spark):
    for name in ("batch_commit_log", "partition_of_key", "gen_shuffled"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    log = QUERIES["batch_commit_log"](spark, "/root/testdata/sf0.001").collect()
    assert len({r["version"] for r in log}) == len(log)


def two_partitions(spark, n=3):
    return source.signed(spark, [("A", 1, "")] * n).unionByName(source.signed(spark, [("B", 1, "")] * n, partition=1))


def test_a_fence_on_one_partition_leaves_the_others(spark, store):
    rows, old, new = two_partitions(spark), LedgerWriter(store), LedgerWriter(store)
    old.start()
    new.start()
    new.write(rows.where("partition_id = 1 and offset_value < 2"))
    with pytest.raises(FencedError) as fence:
        old.write(rows)
    assert fence.value.partitions == [("ledger-events", 1)]
    assert balances(store) == {"A": 3, "B": 2}
    # the loser never adopts what it lost by committing something else
    with pytest.raises(FencedError):
        old.write(rows.where("partition_id = 1"))
    new.start()  # takes over both
    new.write(rows)
    assert balances(store) == {"A": 3, "B": 3} and ledger.out_of_order(store.changes()).count() == 0


def test_writers_of_different_partitions_share_a_store(spark, store):
    rows, writers = two_partitions(spark, 6), [LedgerWriter(store), LedgerWriter(store)]
    failed = []

    def run(p):
        try:
            for k in range(0, 6, 2):
                writers[p].write(rows.where(f"partition_id = {p} and offset_value >= {k} and offset_value < {k + 2}"))
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=run, args=(p,)) for p in (0, 1)]
    for w in writers:
        w.start()
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and balances(store) == {"A": 6, "B": 6}
    last = {r["account_number"]: r["balance"] for r in ledger.latest_per_account(store.changes()).collect()}
    assert last == {"A": 6, "B": 6} and len(store.history()) == 6


def test_tokens_tell_when_they_moved(spark, store):
    rows, writer = two_partitions(spark), LedgerWriter(store)
    writer.write(rows)
    first = {r["partition_id"]: r["updated_at"] for r in store.token_stamps().collect()}
    time.sleep(0.01)
    writer.write(source.signed(spark, [("B", 1, "")] * 4, partition=1))
    store.compact(store.current())
    second = {r["partition_id"]: (r["num_offset"], r["updated_at"]) for r in store.token_stamps().collect()}
    assert second[0] == (2, first[0]) and second[1][0] == 3 and second[1][1] > first[1]


def test_tiers_bound_the_manifest(spark, store):
    held, total = store.current(), 0
    for k in range(9):
        rows = source.signed(spark, [("A", k, "")]).withColumn("offset_value", F.lit(k).cast("long"))
        held = store.publish(held, [store.stage("changes", ledger.ledger_changes(rows))], [store.stage("balances", ledger.balances(rows))], tokens={("ledger-events", 0): k}, rows={"changes": 1})
        held, total = store.tidy(held, together=3), total + k
        assert max(len(held.changes), len(held.balances)) <= 5
        assert (balances(store), store.changes().count()) == ({"A": total}, k + 1)
    assert store.commit_log().count() == 9 and held.tokens == {("ledger-events", 0): 8}
    assert store.expire() > 0 and len(store.history()) == 1
    assert (balances(store), store.changes().count()) == ({"A": 36}, 9)
