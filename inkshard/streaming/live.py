"""The log operators over streams.

Streams need ``ts TIMESTAMP``.  Rows that come later than the watermark are dropped and counted:
``drain`` writes their number to a table if it is given a folder, ``late_rows`` reads it back.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from inkshard.functions import constants as K
from inkshard.operators.conversion_log import ROUTE, bucket_counts, bucket_quantile
from inkshard.operators.render import render_pages

LATENESS = "10 minutes"

# Seconds of event time that wait together under one key.
SLOT_S = 3600

#: Edges that go through the join with their slot's level as one row.
BLOCK = 8_192


def _windowed(stream: DataFrame, keys: Sequence[str], length: str, slide: str | None, lateness: str):
    return stream.withWatermark("ts", lateness).groupBy(F.window("ts", length, slide), *keys)


def _flat(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "window"]
    return df.select(F.unix_micros("window.start").alias("from_us"), F.unix_micros("window.end").alias("to_us"), *rest)


def stream_route_counters(stream: DataFrame, every: str, lateness: str = LATENESS) -> DataFrame:
    """Successes and failures per route and scrape interval."""
    return _flat(_windowed(stream, ROUTE, every, None, lateness).agg(F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures")))


def stream_rate(stream: DataFrame, length: str, slide: str, seconds: int, lateness: str = LATENESS) -> DataFrame:
    """Events per second and share of errors over sliding windows of ``length`` (= ``seconds``)."""
    n = F.count(F.lit(1))
    return _flat(_windowed(stream, [], length, slide, lateness).agg((n / F.lit(float(seconds))).alias("rate"), (F.count_if(~F.col("ok")) * 100.0 / n).alias("error_percent")))


def stream_histogram(stream: DataFrame, value: str, buckets: Sequence[float] = K.CONVERSION_BUCKETS, every: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """Total and 95th percentile from buckets, per window."""
    wide = _windowed(stream, [], every, None, lateness).agg(bucket_counts(F.col(value), buckets).alias("c"))
    return _flat(wide.select("window", F.element_at("c", -1).alias("n"), bucket_quantile(0.95, "c", buckets).alias("p95")))


class _Slot(StatefulProcessor):
    """First step: the rows of one (key, slot) of time wait in a list that is only appended to, a block of bytes for each batch of rows.

    When the watermark has passed the slot they are sorted once and handed to ``close``, which
    makes the output rows, columns in the order of ``names``; then the list goes.
    """

    def __init__(self, columns: Sequence[str], order: Sequence[str], names: Sequence[str], width_us: int, close: Callable[[np.ndarray], Iterator[tuple]]):
        self.columns, self.order, self.names, self.width_us, self.close_slot = list(columns), list(order), list(names), width_us, close

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "block binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.waiting.exists()
        for pdf in rows:
            pdf = pdf[self.columns].dropna()
            if len(pdf):
                self.waiting.appendList([(pdf.to_numpy(np.int64).tobytes(),)])
                if not known:
                    self.handle.registerTimer((int(key[1]) + 1) * self.width_us // 1000)
                    known = True
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = np.concatenate([np.frombuffer(block, dtype=np.int64) for (block,) in self.waiting.get()]).reshape(-1, len(self.columns))
        self.waiting.clear()
        held = held[np.lexsort([held[:, self.columns.index(c)] for c in reversed(self.order)])]
        until = pd.Timestamp((int(key[1]) + 1) * self.width_us, unit="us", tz="UTC")
        yield pd.DataFrame([(key[0], key[1], until, *made) for made in self.close_slot(held)], columns=self.names)

    def close(self) -> None:
        pass


class _Compose(StatefulProcessor):
    """Second step: one number of state for each key; ``step(value, row)`` takes the slots' summaries in order of time."""

    def __init__(self, key: str, names: Sequence[str], step: Callable[[int, tuple], tuple[int, list[tuple]]]):
        self.key, self.names, self.step = key, list(names), step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "value bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A micro-batch brings all slots that its watermark has passed, later ones than any before.
        value, out = (int(self.value.get()[0]) if self.value.exists() else 0), []
        for row in pd.concat(list(rows)).sort_values("slot").itertuples():
            value, made = self.step(value, row)
            out.extend((key[0], *m) for m in made)
        if value:
            self.value.update((value,))
        else:
            self.value.clear()
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _slots(rows: DataFrame, key: str, at: str, columns: Sequence[str], order: Sequence[str], result: str, close: Callable, slot_s: int, lateness: str) -> DataFrame:
    """``close`` over each (key, slot): a key's rows are in as many tasks as it has open slots.

    ``columns`` are bigint; the first of ``order``, in microseconds and no earlier than ``at``, names the slot.
    Rows with a null in ``columns`` are ignored, see ``closing``.
    """
    width = slot_s * 1_000_000
    out = f"{key} bigint, slot bigint, until timestamp, {result}"
    rows = rows.withWatermark(at, lateness).withColumn("slot", F.floor(F.col(order[0]) / width).cast("bigint"))
    return rows.groupBy(key, "slot").transformWithStateInPandas(_Slot(columns, order, _names(out), width, close), out, "append", "EventTime", eventTimeColumnName="until")


def _composed(slots: DataFrame, key: str, result: str, step: Callable, timed: bool) -> DataFrame:
    out = f"{key} bigint, {result}"
    return slots.groupBy(key).transformWithStateInPandas(_Compose(key, _names(out), step), out, "append", "EventTime", eventTimeColumnName="until" if timed else "")


def stream_failure_streak(stream: DataFrame, key: str = "worker_id", alarm_at: int = 3, lateness: str = LATENESS, slot_s: int = SLOT_S) -> DataFrame:
    """An alarm row whenever a worker's streak of failures reaches ``alarm_at``.

    Rows wait in slots of ``slot_s`` seconds of event time until the watermark has passed the slot, so neither
    the order of files nor the cut into micro-batches shows in the result, nor does the slot.  What a slot says about
    its worker is one row: the failures before its first success, of which only the first ``alarm_at``
    can be an alarm of a streak from earlier slots, those after its last, and the alarms in between, which are its own.
    """

    def close(held: np.ndarray) -> Iterator[tuple]:
        ok = held[:, 2] != 0
        n, first = len(ok), int(ok.argmax()) if ok.any() else len(ok)
        at = np.arange(n)
        streak = at - np.maximum.accumulate(np.where(ok, at, -1))
        alarms = held[(streak == alarm_at) & ~ok & (at > first)]
        opening = held[:min(first, alarm_at)]
        tail = int(streak[-1]) if first < n else n
        yield first, tail, first < n, opening[:, 1].tolist(), opening[:, 0].tolist(), alarms[:, 1].tolist(), alarms[:, 0].tolist()

    def step(streak: int, slot) -> tuple[int, list[tuple]]:
        need, made = alarm_at - streak, []
        if 0 < need <= slot.opening:
            made.append((int(slot.opening_ids[need - 1]), int(slot.opening_us[need - 1])))
        made.extend((int(i), int(t)) for i, t in zip(slot.alarm_ids, slot.alarm_us, strict=True))
        return (int(slot.tail) if slot.reset else streak + int(slot.tail)), made

    rows = stream.select(key, "event_id", "ts_us", F.col("ok").cast("bigint").alias("ok"), "ts")
    said = "opening bigint, tail bigint, reset boolean, opening_ids array<bigint>, opening_us array<bigint>, alarm_ids array<bigint>, alarm_us array<bigint>"
    slots = _slots(rows, key, "ts", ["ts_us", "event_id", "ok"], ["ts_us", "event_id"], said, close, slot_s, lateness)
    return _composed(slots, key, "event_id bigint, ts_us bigint", step, False)


def stream_active(edges: DataFrame, key: str = "worker_id", lateness: str = LATENESS, slot_s: int = SLOT_S) -> DataFrame:
    """Conversions in flight per worker after each edge ``(key, event_id, t_us, delta, seen)``, never below zero.

    ``seen`` is when the stream learns of an edge, which for an end is the start of its conversion;
    edges count at ``t_us`` all the same.  Edges wait in slots of ``slot_s`` seconds; a slot tells its worker
    only its sum and its lowest prefix, gets the level it starts from, and its edges, in blocks of ``BLOCK``, are joined with that.  So a
    worker's edges stay in as many tasks as it has slots, and one number for each slot meets in the worker's task.
    """

    def close(held: np.ndarray) -> Iterator[tuple]:
        sums = held[:, 1].cumsum()
        lows = np.minimum.accumulate(sums)
        for i in range(0, len(held), BLOCK):
            at = slice(i, i + BLOCK)
            yield held[at, 2], held[at, 0], held[at, 1], sums[at], lows[at]

    def summed(held: np.ndarray) -> Iterator[tuple]:
        sums = held[:, 1].cumsum()
        yield int(sums[-1]), int(sums.min())

    def step(level: int, slot) -> tuple[int, list[tuple]]:
        return level + int(slot.total) - min(0, level + int(slot.lowest)), [(slot.slot, slot.until, level)]

    rows = edges.select(key, "event_id", "t_us", F.col("delta").cast("bigint").alias("delta"), "seen")
    slots = lambda result, how: _slots(rows, key, "seen", ["t_us", "delta", "event_id"], ["t_us", "delta", "event_id"], result, how, slot_s, lateness)
    edge = ["event_id", "t_us", "delta", "total", "low"]
    each = slots(", ".join(f"{c} array<bigint>" for c in edge), close)
    starts = _composed(slots("total bigint, lowest bigint", summed), key, "slot bigint, until timestamp, level bigint", step, True)
    active = F.col("level") + F.col("x.total") - F.least(F.lit(0), F.col("level") + F.col("x.low"))
    same = F.col("e.slot").eqNullSafe(F.col("s.slot")) & F.col(f"e.{key}").eqNullSafe(F.col(f"s.{key}")) & (F.col("e.until") == F.col("s.until"))
    met = each.alias("e").join(starts.alias("s"), same).select(f"e.{key}", "level", F.explode(F.arrays_zip(*edge)).alias("x"))
    return met.select(key, "x.event_id", "x.t_us", F.col("x.delta").cast("int").alias("delta"), active.alias("active"))


def stream_convert(pages: DataFrame, out_dir: str, checkpoint: str, dialect: str = "plain", arrived: str | None = None, within: str = "1 day"):
    """Render pages as they arrive, each doc_id once; every micro-batch owns a folder, so a replay overwrites itself.

    A doc_id that was rendered is kept in state, and a page that comes again under it is left out; of those that
    come in one micro-batch any one is rendered.  ``arrived`` names a timestamp column, after which an id is
    forgotten ``within`` that time, so that the state stays bounded; without it ids are kept for good.
    """
    ids = ["doc_id"]
    once = pages.dropDuplicates(ids) if arrived is None else pages.withWatermark(arrived, within).dropDuplicatesWithinWatermark(ids)

    def render(batch: DataFrame, batch_id: int) -> None:
        render_pages(batch, dialect).write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    return once.writeStream.foreachBatch(render).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """Lists and timers in state need the RocksDB store; a query keeps what the session named when it started."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


LATE = "query string, batch bigint, operator string, n_late bigint"


class _LateRows(StreamingQueryListener):
    """Writes what each micro-batch of one query dropped as late, a folder for each, so that a replay overwrites itself."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.run, self.done = spark, folder, None, threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = [(str(p.id), int(p.batchId), o.operatorName, int(o.numRowsDroppedByWatermark)) for o in p.stateOperators if o.numRowsDroppedByWatermark]
        if late and (self.run is None or str(p.runId) == self.run):
            self.spark.createDataFrame(late, LATE).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{p.id}-{p.batchId}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self.run is None or str(event.runId) == self.run:
            self.done.set()


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``(query, batch, operator, n_late)`` as written by ``drain``: a row for each operator and micro-batch that dropped any.

    Stateful steps count rows; windowed counters count what reaches their state, rows of one task and window that
    were combined before being one.
    """
    return spark.read.schema(LATE).option("recursiveFileLookup", "true").parquet(folder)


def drain(df: DataFrame, out_dir: str, checkpoint: str, late_dir: str | None = None) -> None:
    """Process what is there, append it to a folder and stop; ``late_dir`` takes the counts of late rows."""
    spark = df.sparkSession
    query = df.writeStream.format("parquet").outputMode("append").option("path", out_dir).option("checkpointLocation", checkpoint)
    late = None
    if late_dir is not None:
        spark.createDataFrame([], LATE).write.mode("ignore").parquet(late_dir)
        late = _LateRows(spark, late_dir)
        spark.streams.addListener(late)
    try:
        with _state_store(spark):
            running = query.trigger(availableNow=True).start()
        if late is not None:
            late.run = str(running.runId)
        running.awaitTermination()
        if late is not None:
            late.done.wait(60)
    finally:
        if late is not None:
            spark.streams.removeListener(late)


def closable(stream: DataFrame, folder: str) -> DataFrame:
    """The stream and the rows of a folder that is empty until ``close_stream`` writes to it."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(folder)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder))


def close_stream(stream: DataFrame, folder: str, ts: str = "ts") -> None:
    """Say that no more rows come: one row, null but for a far ``ts``, moves the watermark past everything.

    Windows still open and rows still waiting come out when the stream is drained once more.
    """
    row = {ts: datetime(2200, 1, 1, tzinfo=timezone.utc)}
    stream.sparkSession.createDataFrame([tuple(row.get(c) for c in stream.columns)], stream.schema).write.mode("append").parquet(folder)


def read_table_stream(spark: SparkSession, pattern: str, ts: str | None = None, max_files: int = 100) -> DataFrame:
    """A parquet folder or file pattern as a stream, with ``ts`` cast for watermarks.

    ``max_files`` bounds a micro-batch; it shows in no result.
    """
    schema = spark.read.parquet(pattern).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(pattern)
    return stream if ts is None else stream.withColumn(ts, F.col(ts).cast("timestamp"))


def edges_of(log: DataFrame, busy_s: Column, key: str = "worker_id") -> DataFrame:
    """Start and end edges of each conversion."""
    end_us = F.col("ts_us") + F.floor(busy_s * 1_000_000).cast("bigint")
    edge = lambda at, d: F.struct(at.alias("t_us"), F.lit(d).alias("delta"))
    both = F.explode(F.array(edge(F.col("ts_us"), 1), edge(end_us, -1))).alias("e")
    return log.select(key, "event_id", F.col("ts").alias("seen"), both).select(key, "event_id", "e.t_us", "e.delta", "seen")
