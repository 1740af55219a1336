"""Timers that fire in a running stream, without input."""

import time

import pytest

from ledgerloom.model import Watermarks
from ledgerloom.streaming import state, timers


def run_until(spark, stream, out, check, wanted, limit=90):
    query = stream.writeStream.format("parquet").option("checkpointLocation", check).trigger(processingTime="0 seconds").start(out)
    try:
        end = time.monotonic() + limit
        while time.monotonic() < end and query.exception() is None:
            try:
                rows = spark.read.parquet(out).collect()
            except Exception:  # noqa: BLE001  nothing is written yet
                rows = []
            if len(rows) >= wanted:
                return rows
            time.sleep(0.5)
        raise AssertionError(query.exception() or "nothing fired in time")
    finally:
        query.stop()


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.STATE_STORE)


def test_self_timers_fire_once_in_order(spark, tmp_path):
    rows = [("a", 1, 1500), ("a", 2, 10), ("a", 3, -1), ("a", 4, None), ("stopped", 5, 10), ("stopped", None, None), ("b", 6, 0)]
    schema = "actor string, timer_id long, delay_ms long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = timers.self_timers(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    found = run_until(spark, stream, str(tmp_path / "out"), str(tmp_path / "check"), 5)
    assert sorted((r["actor"], r["timer_id"], r["outcome"]) for r in found) == [("a", 1, "FIRED"), ("a", 2, "FIRED"), ("a", 3, "REJECTED"), ("a", 4, "REJECTED"), ("b", 6, "FIRED")]
    assert all(r["fired_ms"] >= r["due_ms"] for r in found if r["outcome"] == "FIRED")


def test_backpressure_is_released_without_input(spark, tmp_path):
    rows = [("t", 0, 0, 5), ("t", 0, 1, 100), ("t", 0, 2, 60), ("t", 1, 0, 90), ("t", 1, 1, 3), ("t", 2, 0, None), ("t", 2, 1, 50)]
    schema = "topic string, partition_id int, offset_value long, depth long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = timers.backpressure_edges(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), Watermarks(80, 20), every_ms=200, per_second=100.0)
    found = run_until(spark, stream, str(tmp_path / "out"), str(tmp_path / "check"), 4)
    edges = sorted((r["partition_id"], r["offset_value"], r["edge"], r["source"]) for r in found)
    assert edges == [(0, 1, "ENGAGED", "input"), (0, 2, "RELEASED", "tick"), (1, 0, "ENGAGED", "input"), (1, 1, "RELEASED", "input")]
    assert all(r["depth"] <= 20 for r in found if r["edge"] == "RELEASED")
