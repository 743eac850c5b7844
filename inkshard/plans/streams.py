"""Queries that run a stream over a table until it is drained and return what it wrote."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from inkshard.functions import constants as K
from inkshard.operators import conversion_log as L
from inkshard.plans.conversion_log import LOG, _sql_histogram, _sql_quantile
from inkshard.plans.documents import _render_sql
from inkshard.plans.registry import plan
from inkshard.plans.views import CONV_LOG_COLUMNS
from inkshard.session import shared_dir
from inkshard.streaming import live

_HOUR = 3_600_000_000


def _drained(spark, sf, make, max_files=100):
    """What a stream over the log has written once it was drained, closed and drained again."""
    base = f"{shared_dir(spark)}/{uuid4().hex}"
    events = live.read_table_stream(spark, f"{sf}/events*.parquet", "ts", max_files)
    log = live.closable(events, f"{base}/closing")
    out = make(log.selectExpr("event_id", "ts", "unix_micros(ts) AS ts_us", *CONV_LOG_COLUMNS))
    live.drain(out, f"{base}/out", f"{base}/state")
    live.close_stream(events, f"{base}/closing")
    live.drain(out, f"{base}/out", f"{base}/state")
    return spark.read.schema(out.schema).parquet(f"{base}/out")


@plan(
    "r1_stream_route_counters",
    f"""{LOG}, w AS (SELECT ts_us // {6 * _HOUR} * {6 * _HOUR} AS from_us, source_format, target_format, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures FROM log GROUP BY ALL)
    SELECT from_us, from_us + {6 * _HOUR} AS to_us, source_format, target_format, successes, failures FROM w""",
)
def _(spark, sf):
    return _drained(spark, sf, lambda log: live.stream_route_counters(log, "6 hours"))


@plan(
    "r2_stream_rate",
    f"""{LOG}, w AS (SELECT *, ts_us // {_HOUR} * {_HOUR} - k * {_HOUR} AS from_us FROM log, (VALUES (0), (1), (2)) t(k))
    SELECT from_us, from_us + {3 * _HOUR} AS to_us, round(count(*) / 10800.0, 9) AS rate, round(count(*) FILTER (NOT ok) * 100.0 / count(*), 6) AS error_percent FROM w GROUP BY 1""",
)
def _(spark, sf):
    out = _drained(spark, sf, lambda log: live.stream_rate(log, "3 hours", "1 hour", 10800))
    return out.withColumns({"rate": F.round("rate", 9), "error_percent": F.round("error_percent", 6)})


@plan(
    "r3_stream_histogram",
    f"""{LOG}, s AS (SELECT ts_us // {6 * _HOUR} * {6 * _HOUR} AS from_us, duration_s FROM log WHERE ok), q AS ({_sql_quantile(0.95, 'duration_s', K.CONVERSION_BUCKETS, 'from_us', 's')}), h AS ({_sql_histogram('duration_s', K.CONVERSION_BUCKETS, 'from_us', 's')})
    SELECT from_us, from_us + {6 * _HOUR} AS to_us, h.n, round(q.p, 6) AS p95 FROM h JOIN q USING (from_us) WHERE le = '+Inf'""",
)
def _(spark, sf):
    return _drained(spark, sf, lambda log: live.stream_histogram(log.filter("ok IS NOT FALSE"), "duration_s", every="6 hours")).withColumn("p95", F.round("p95", 6))


@plan(
    "r4_stream_failure_streak",
    f"""{LOG}, s AS (SELECT worker_id, event_id, ts_us, ok, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY worker_id ORDER BY ts_us, event_id) AS streak FROM log),
    p AS (SELECT *, row_number() OVER (PARTITION BY worker_id, streak ORDER BY ts_us, event_id) AS p FROM s WHERE NOT ok) SELECT worker_id, event_id, ts_us FROM p WHERE p = 3""",
)
def _(spark, sf):
    return _drained(spark, sf, lambda log: live.stream_failure_streak(log, slot_s=6 * 3600))


@plan("r5_stream_convert", _render_sql("plain"))
def _(spark, sf):
    pages = live.read_table_stream(spark, f"{sf}/pages*.parquet").select(F.col("page_id").alias("doc_id"), "html")
    base = f"{shared_dir(spark)}/{uuid4().hex}"
    live.stream_convert(pages, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")


_BY_WORKER = """e AS (SELECT worker_id, event_id, ts_us AS t_us, 1 AS delta FROM log UNION ALL SELECT worker_id, event_id, ts_us + CAST(floor(busy_s * 1000000) AS BIGINT), -1 FROM log),
 s AS (SELECT *, sum(delta) OVER (PARTITION BY worker_id ORDER BY t_us, delta, event_id) AS s FROM e)"""


@plan("r6_stream_active", f"{LOG}, {_BY_WORKER} SELECT worker_id, event_id, t_us, delta, CAST(s - least(0, min(s) OVER (PARTITION BY worker_id ORDER BY t_us, delta, event_id)) AS BIGINT) AS active FROM s")
def _(spark, sf):
    return _drained(spark, sf, lambda log: live.stream_active(live.edges_of(log, F.col("busy_s")), slot_s=6 * 3600))


@plan("r6_active_by_worker", f"{LOG}, {_BY_WORKER} SELECT worker_id, event_id, t_us, delta, CAST(s - least(0, min(s) OVER (PARTITION BY worker_id ORDER BY t_us, delta, event_id)) AS BIGINT) AS active FROM s")
def _(spark, sf):
    from inkshard.plans.views import conv_log

    return L.active_conversions(conv_log(spark, sf), keys=["worker_id"])
