"""Scans along time over a log whose rows lie in one second, against plain windows, and where their rows run."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from inkshard.operators import conversion_log as L
from inkshard.operators.ordered import over_ranges

N = 4000


@pytest.fixture(scope="module", params=["one second", "one microsecond", "spread"])
def log(request, spark):
    """One worker and route hold nearly all rows."""
    width = {"one second": 1_000_000, "one microsecond": 1, "spread": 40_000_000_000}[request.param]
    rows = spark.range(N).select(
        F.col("id").alias("event_id"),
        (F.lit(1_700_000_000_000_000) + F.abs(F.hash("id", F.lit(1))).cast("long") % width).alias("ts_us"),
        F.when(F.col("id") < N - 40, 1).when(F.col("id") < N - 3, F.col("id") % 3 + 2).alias("worker_id"),
        (F.abs(F.hash("id", F.lit(2))) % 5 > 2).alias("ok"),
        ((F.abs(F.hash("id", F.lit(3))) % 1000) / 100).alias("busy_s"),
        F.lit("html").alias("source_format"),
        F.when(F.col("id") < N - 40, "pdf").alias("target_format"),
    )
    return rows.repartition(5).cache()


def rows_of(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.fixture(autouse=True)
def as_planned(spark):
    """Small partitions stay apart."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


def several_tasks(df):
    return df.select(F.spark_partition_id()).distinct().count() > 2


SCANS = {
    "failure_streaks": lambda log, **k: L.failure_streaks(log, **k),
    "streak_lengths": lambda log, **k: L.streak_lengths(log, **k),
    "active_conversions": lambda log, **k: L.active_conversions(log, **k),
    "restart_points": lambda log, **k: L.restart_points(log, 3, **k),
    "health_restarts": lambda log, **k: L.health_restarts(log, **k),
    "trailing_rate": lambda log, **k: L.trailing_rate(log, 300, **k),
}


@pytest.mark.parametrize("name", SCANS)
def test_ranges_equal_one_range(log, name):
    out = SCANS[name](log, ranges=16)
    assert several_tasks(out)
    want = rows_of(SCANS[name](log, ranges=1))
    assert want and rows_of(out) == want


def test_scans_cut_a_burst(log):
    """The biggest piece of one key that a window sees."""
    sizes = over_ranges(log.select("worker_id", "ts_us", "event_id"), ["worker_id"], ["ts_us", "event_id"], lambda df, scan: df.groupBy("worker_id", *scan.pieces).count().withColumnRenamed("_chunk", "piece"), 16)
    assert sizes.filter("worker_id = 1").count() >= 12 and sizes.agg(F.max("count")).first()[0] < N / 4


@pytest.mark.parametrize("span", [1, 300, 7200])
def test_rate_against_a_window(log, span):
    w = Window.partitionBy("source_format", "target_format").orderBy("ts_us").rangeBetween(-span * 1_000_000, 0)
    want = log.select("source_format", "target_format", "ts_us", "event_id", (F.count(F.lit(1)).over(w) / F.lit(float(span))).alias("rate"))
    assert rows_of(L.trailing_rate(log, span, ranges=7)) == rows_of(want)


def test_rate_counts_repeated_rows(spark):
    log = spark.createDataFrame([("a", None, 5_000_000, 1)] * 3 + [("a", None, 6_000_000, 2), ("a", None, 5_999_999, 2)], "source_format string, target_format string, ts_us long, event_id long")
    got = sorted((r.ts_us, r.rate) for r in L.trailing_rate(log, 1).collect())
    assert got == [(5_000_000, 3.0)] * 3 + [(5_999_999, 4.0), (6_000_000, 5.0)]


def test_no_rows(log):
    for scan in SCANS.values():
        assert scan(log.filter("false")).collect() == []


def test_xor_over_ranges(log):
    w = Window.partitionBy("worker_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.select("worker_id", "event_id", "ts_us")
    body = lambda df, scan: scan.running(df, x=("xor", F.col("ts_us")))
    got = over_ranges(rows, ["worker_id"], ["event_id"], body, 9)
    assert rows_of(got) == rows_of(rows.withColumn("x", F.bit_xor("ts_us").over(w)))
