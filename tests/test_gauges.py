"""Gauges at the end of a worker log, case by case."""

from inkshard.sources.metrics import gauge_lines

SCHEMA = "worker_id long, event_id long, ts_us long, event string, ok boolean, duration_ms double, cpu_percent double, memory_mb double, queue_size long"


def lines(spark, rows, **info):
    return {r.value for r in gauge_lines(spark.createDataFrame(rows, SCHEMA), info).collect()}


def test_state_at_the_end(spark):
    rows = [
        (1, 1, 0, "convert", True, 10_000.0, 1.0, 1.0, 9), (1, 2, 2_000_000, "start", True, 1.0, 2.0, 1.0, 8), (1, 3, 3_000_000, "check_failed", False, 0.5, 3.0, 1.0, 7),
        (1, 4, 3_000_000, "check_failed", False, 7_000.0, 12.5, 1.5, 3), (2, 5, 1_000_000, "check_failed", False, 1.0, None, None, None), (None, 6, 9_000_000, "convert", True, 1.0, 1.0, 1.0, 1),
    ]
    got = lines(spark, rows, version="2", build="x")
    w = lambda name, worker, value: f'worker_{name}{{worker="{worker}"}} {value}'
    want = {w("uptime_seconds", 1, "1.000"), w("consecutive_failures", 1, 2), w("cpu_percent", 1, "12.500"), w("memory_bytes", 1, 1572864), w("queue_size", 1, 3), w("active_conversions", 1, 3)}
    want |= {w("uptime_seconds", 2, "0.000"), w("consecutive_failures", 2, 1), w("active_conversions", 2, 1), "active_conversions 4", "uptime_seconds 3.000", 'service_info{build="x",version="2"} 1'}
    assert got == want


def test_nothing(spark):
    assert lines(spark, []) == set() and lines(spark, [], v="1") == {'service_info{v="1"} 1'}
