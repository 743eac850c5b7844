"""Streams: the cut into micro-batches and the order of files must not show; nothing stays behind."""

import random
import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from inkshard.operators import conversion_log as L
from inkshard.streaming import live

T0 = 1_700_000_000_000_000


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """A log in six files, rows of a worker scattered over all of them."""
    rng = random.Random(9)
    rows = [(i, T0 + i * 20_000_000, i % 3, rng.random() < 0.45, rng.random() * 200, "html", rng.choice(["pdf", "docx"])) for i in range(240)]
    folder = tmp_path_factory.mktemp("stream")
    rng.shuffle(rows)
    for part in range(6):
        df = spark.createDataFrame(rows[part::6], "event_id long, ts_us long, worker_id long, ok boolean, busy_s double, source_format string, target_format string")
        df.withColumn("ts", F.timestamp_micros("ts_us")).coalesce(1).write.mode("append").parquet(str(folder / f"log{(part * 5) % 6}"))
    return str(folder / "log*")


def drained(spark, events, folder, make, max_files):
    stream = live.read_table_stream(spark, events, max_files=max_files)
    out = make(live.closable(stream, f"{folder}/closing"))
    live.drain(out, f"{folder}/out", f"{folder}/state")
    live.close_stream(stream, f"{folder}/closing")
    live.drain(out, f"{folder}/out", f"{folder}/state")
    return sorted(map(str, spark.read.schema(out.schema).parquet(f"{folder}/out").collect()))


OPERATORS = {
    "counters": lambda log: live.stream_route_counters(log, "10 minutes", "3 hours"),
    "rate": lambda log: live.stream_rate(log, "20 minutes", "10 minutes", 1200, "3 hours"),
    "histogram": lambda log: live.stream_histogram(log, "busy_s", every="15 minutes", lateness="3 hours"),
    "streak": lambda log: live.stream_failure_streak(log, lateness="3 hours", slot_s=1200),
    "active": lambda log: live.stream_active(live.edges_of(log, F.col("busy_s")), lateness="3 hours", slot_s=1200),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_micro_batches_do_not_show(spark, events, tmp_path, name):
    one, all_ = (drained(spark, events, str(tmp_path / str(n)), OPERATORS[name], n) for n in (2, 100))
    assert one == all_ and one


def test_streams_agree_with_batch(spark, events, tmp_path):
    log = spark.read.parquet(events)
    streaks = L.failure_streaks(log).filter("streak_pos = 3").select("worker_id", "event_id", "ts_us")
    assert drained(spark, events, str(tmp_path / "a"), OPERATORS["streak"], 2) == sorted(map(str, streaks.collect()))
    active = L.active_conversions(log, keys=["worker_id"]).select("worker_id", "event_id", "t_us", F.col("delta").cast("int"), "active")
    assert drained(spark, events, str(tmp_path / "b"), OPERATORS["active"], 2) == sorted(map(str, active.collect()))
    counted = drained(spark, events, str(tmp_path / "c"), OPERATORS["counters"], 2)
    assert len(counted) == len(log.groupBy(F.floor(F.col("ts_us") / 600_000_000), "target_format").count().collect())


def test_one_key_spreads_over_tasks(spark):
    """All conversions of a log under no key at all: cut by time."""
    log = spark.range(5000).select(F.col("id").alias("event_id"), (F.col("id") * 60_000_000).alias("ts_us"), F.lit(90.0).alias("busy_s"))
    out = L.active_conversions(log).withColumn("task", F.spark_partition_id())
    assert out.select("task").distinct().count() > 2
    assert out.filter("delta = 1").agg(F.max("active")).first()[0] == 2


@pytest.mark.parametrize("arrived", [None, "at"])
def test_a_page_that_comes_again_is_rendered_once(spark, tmp_path, arrived):
    schema = "doc_id long, html string, at timestamp"
    page = lambda i: spark.createDataFrame([(i, f"<p>page {i}</p>", datetime(2024, 1, 1))], schema)
    for ids in ((1, 2), (2, 3), (3, 3)):
        for i in ids:
            page(i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        live.stream_convert(stream, f"{tmp_path}/out", f"{tmp_path}/state", arrived=arrived).awaitTermination()
    assert sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(i, f"page {i}") for i in (1, 2, 3)]


def test_one_worker_of_a_stream_spreads_over_tasks(spark, tmp_path):
    rows = [(i, T0 + i * 60_000_000, 1, 90.0) for i in range(120)]
    log = spark.createDataFrame(rows, "event_id long, ts_us long, worker_id long, busy_s double").withColumn("ts", F.timestamp_micros("ts_us"))
    log.write.parquet(f"{tmp_path}/log")
    make = lambda s: live.stream_active(live.edges_of(s, F.col("busy_s")), slot_s=600).withColumn("task", F.spark_partition_id())
    drained(spark, f"{tmp_path}/log", f"{tmp_path}/x", make, 100)
    out = spark.read.parquet(f"{tmp_path}/x/out")
    assert out.count() == 240 and out.select("task").distinct().count() > 2
    assert out.filter("delta = 1").agg(F.max("active")).first()[0] == 2


def test_late_rows_are_counted_in_a_table(spark, tmp_path):
    schema = "event_id long, ts_us long, worker_id long, ok boolean"
    minutes = [[0, 1, 2, 60], [61, 120], [3, 4, 121]]
    for i, batch in enumerate(minutes):
        rows = [(10 * i + j, T0 + m * 60_000_000, 1, False) for j, m in enumerate(batch)]
        df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("ts_us")).coalesce(1)
        df.write.parquet(f"{tmp_path}/log{i}")
        stream = live.read_table_stream(spark, f"{tmp_path}/log*")
        live.drain(live.stream_failure_streak(stream, lateness="10 minutes"), f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/late")
        late = live.late_rows(spark, f"{tmp_path}/late").collect()
        assert sum(r.n_late for r in late) == (2 if i == 2 else 0)
    assert {r.operator for r in late} == {"transformWithStateInPandasExec"}


def test_edges_are_kept_and_joined_in_blocks(spark, tmp_path, monkeypatch):
    """State of the join holds a row for each block of a slot's edges, whatever the number of edges."""
    monkeypatch.setattr(live, "BLOCK", 64)
    log = spark.range(300).select(F.col("id").alias("event_id"), (F.lit(T0 // 3_600_000_000 * 3_600_000_000) + F.col("id") * 1_000_000).alias("ts_us"), (F.col("id") % 2).alias("worker_id"), F.lit(90.0).alias("busy_s"))
    log = log.withColumn("ts", F.timestamp_micros("ts_us"))
    log.write.parquet(f"{tmp_path}/log")
    joined = []
    listener = _Joined(joined)
    spark.streams.addListener(listener)
    try:
        got = drained(spark, f"{tmp_path}/log", f"{tmp_path}/x", lambda s: live.stream_active(live.edges_of(s, F.col("busy_s"))), 100)
        assert listener.closed.wait(60)
    finally:
        spark.streams.removeListener(listener)
    want = L.active_conversions(log, keys=["worker_id"]).select("worker_id", "event_id", "t_us", F.col("delta").cast("int"), "active")
    assert got == sorted(map(str, want.collect())) and len(got) == 600
    # 300 edges of each worker in its hour: 5 blocks; and two levels.
    assert 0 < sum(joined) <= 12


class _Joined(StreamingQueryListener):
    """Rows put into the state of stream-stream joins."""

    def __init__(self, counts):
        self.counts, self.ended, self.closed = counts, 0, threading.Event()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.counts.extend(o.numRowsUpdated for o in event.progress.stateOperators if o.operatorName == "symmetricHashJoin")

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended += 1
        if self.ended == 2:
            self.closed.set()
