"""Counters, histograms, quantiles, rates and streaks over a log of conversions.

Every aggregate here combines on the map side, so a route or worker holding a large
share of the log shuffles only its partial results.  Scans along time go through
``over_ranges``: a burst of one worker within one second spreads over as many tasks as its rows need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkshard.functions import constants as K
from inkshard.functions.policy import bearer_token, protected_path
from inkshard.operators.ordered import Scan, over_ranges

ROUTE = ["source_format", "target_format"]
TIME = ["ts_us", "event_id"]


def conversion_log(events: DataFrame, ts: str, source: Column, target: Column, ok: Column, duration_s: Column, request_bytes: Column, response_bytes: Column, has_template: Column) -> DataFrame:
    """Project any event table, batch or stream, onto the log the operators read."""
    return events.select(
        "event_id",
        F.col(ts).cast("timestamp").alias("ts"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("ts_us"),
        source.alias("source_format"),
        target.alias("target_format"),
        ok.alias("ok"),
        duration_s.alias("duration_s"),
        request_bytes.alias("request_bytes"),
        response_bytes.alias("response_bytes"),
        has_template.alias("has_template"),
    )


def route_counters(log: DataFrame) -> DataFrame:
    return log.groupBy(*ROUTE).agg(F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"))


def template_counters(log: DataFrame) -> DataFrame:
    return log.filter(F.col("ok") & F.col("has_template")).groupBy("target_format").agg(F.count(F.lit(1)).alias("conversions"))


def error_rate_percent(log: DataFrame, *keys: str, digits: int | None = None) -> DataFrame:
    """Failures as a share of all attempts; 0 without attempts."""
    rate = F.coalesce(F.count_if(~F.col("ok")) * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0))
    return log.groupBy(*keys).agg((rate if digits is None else F.round(rate, digits)).alias("error_rate_percent"))


def error_ratio(log: DataFrame, *keys: str) -> DataFrame:
    """Failures as a share of successes, the form dashboards ask for."""
    return log.groupBy(*keys).agg((F.count_if(~F.col("ok")) * 100.0 / F.nullif(F.count_if("ok"), F.lit(0))).alias("error_ratio"))


def avg_duration(log: DataFrame, *keys: str) -> DataFrame:
    """Mean seconds of successful conversions."""
    return log.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("ok"), F.col("duration_s"))), F.lit(0.0)).alias("avg_seconds"))


def conversions_by_format(log: DataFrame, cube: bool = False) -> DataFrame:
    grouped = log.cube(*ROUTE) if cube else log.rollup(*ROUTE)
    return grouped.agg(F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"), F.grouping_id().alias("level"))


# Histograms.  Buckets are counted side by side in one aggregate, so the shuffle carries
# one row per key and map task whatever the number of buckets.


def bucket_counts(value: Column, buckets: Sequence[float]) -> Column:
    """Cumulative bucket counts as an array; the last one is the total."""
    return F.array(*[F.count_if(value <= F.lit(b)) for b in buckets], F.count(value))


def histogram_arrays(df: DataFrame, value: str, buckets: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(bucket_counts(v, buckets).alias("cumulative"), F.sum(v).alias("sum"), F.count(v).alias("count"))


def bucket_labels(buckets: Sequence[float]) -> list[str]:
    return [f"{b:g}" if b < 1e6 else str(b) for b in buckets] + ["+Inf"]


def histogram(df: DataFrame, value: str, buckets: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, le, cumulative, sum, count)``, one row per bucket and ``+Inf``."""
    labels = F.array(*[F.lit(x) for x in bucket_labels(buckets)])
    wide = histogram_arrays(df, value, buckets, keys)
    rows = wide.select(*keys, "sum", "count", F.explode(F.arrays_zip(labels.alias("le"), F.col("cumulative").alias("n"))).alias("b"))
    return rows.select(*keys, F.col("b.le").alias("le"), F.col("b.n").alias("cumulative"), "sum", "count")


def bucket_quantile(q: float, cumulative: Column | str, buckets: Sequence[float]) -> Column:
    """Quantile from cumulative counts, linear inside a bucket; the open bucket answers its lower bound."""
    c = F.col(cumulative) if isinstance(cumulative, str) else cumulative
    bounds = F.array(*[F.lit(float(b)) for b in buckets])
    rank = F.element_at(c, -1) * F.lit(q)
    i = (F.array_position(F.transform(c, lambda n: n >= rank), True) - 1).cast("int")
    low = F.when(i == 0, F.lit(0.0)).otherwise(F.get(bounds, i - 1))
    before = F.when(i == 0, F.lit(0)).otherwise(F.get(c, i - 1))
    inside = low + (F.get(bounds, i) - low) * (rank - before) / F.nullif(F.get(c, i) - before, F.lit(0))
    return F.when(F.element_at(c, -1) == 0, F.lit(None)).when(i >= len(buckets), F.lit(float(buckets[-1]))).otherwise(F.coalesce(inside, low))


def histogram_quantiles(df: DataFrame, value: str, buckets: Sequence[float], quantiles: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    wide = histogram_arrays(df, value, buckets, keys)
    return wide.select(*keys, *[bucket_quantile(q, "cumulative", buckets).alias(f"p{round(q * 100)}") for q in quantiles])


def size_profile(log: DataFrame) -> DataFrame:
    """Byte histograms of requests and responses with their 95th percentile."""
    agg = log.agg(*[bucket_counts(F.col(c), K.SIZE_BUCKETS).alias(c) for c in ("request_bytes", "response_bytes")])
    labels = F.array(*[F.lit(x) for x in bucket_labels(K.SIZE_BUCKETS)])
    sides = F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("c"), bucket_quantile(0.95, c, K.SIZE_BUCKETS).alias("p95")) for c in ("request_bytes", "response_bytes")])
    rows = agg.select(F.explode(sides).alias("s")).select("s.side", "s.p95", F.explode(F.arrays_zip(labels.alias("le"), F.col("s.c").alias("n"))).alias("b"))
    return rows.select("side", "p95", F.col("b.le").alias("le"), F.col("b.n").alias("cumulative"))


# Along time.


def failure_streaks(log: DataFrame, keys: Sequence[str] = ("worker_id",), ranges: int | None = None) -> DataFrame:
    """Failed rows with their place in the present streak of failures."""
    out = over_ranges(log.select(*keys, *TIME, "ok"), keys, TIME, lambda df, scan: scan.count_since(df, streak_pos=(~F.col("ok"), F.col("ok"))), ranges)
    return out.filter(~F.col("ok")).select(*keys, *TIME, "streak_pos")


def streak_lengths(log: DataFrame, keys: Sequence[str] = ("worker_id",), ranges: int | None = None) -> DataFrame:
    """``(keys, start_us, length)`` of every streak of failures."""
    def body(df: DataFrame, scan: Scan) -> DataFrame:
        return scan.running(df, streak=("sum", F.when(F.col("ok"), 1).otherwise(0)))

    out = over_ranges(log.select(*keys, *TIME, "ok"), keys, TIME, body, ranges).filter(~F.col("ok"))
    return out.groupBy(*keys, "streak").agg(F.min("ts_us").alias("start_us"), F.count(F.lit(1)).alias("length")).drop("streak")


def active_conversions(log: DataFrame, busy_s: str = "busy_s", keys: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Conversions in flight after every start and end; ends come before starts at the same time."""
    end_us = F.col("ts_us") + F.floor(F.col(busy_s) * 1_000_000).cast("bigint")
    edge = lambda at, d: F.struct(at.alias("t_us"), F.lit(d).alias("delta"))
    edges = log.select(*keys, "event_id", F.explode(F.array(edge(F.col("ts_us"), 1), edge(end_us, -1))).alias("e"))
    edges = edges.select(*keys, "event_id", "e.t_us", "e.delta")
    return over_ranges(edges, list(keys), ["t_us", "delta", "event_id"], lambda df, scan: scan.floored_level(df, "active", F.col("delta")), ranges)


def peak_active(active: DataFrame, every_us: int, keys: Sequence[str] = ()) -> DataFrame:
    bucket = (F.floor(F.col("t_us") / every_us) * every_us).cast("bigint").alias("from_us")
    return active.groupBy(*keys, bucket).agg(F.max("active").alias("peak"))


def restart_points(log: DataFrame, n: int, keys: Sequence[str] = ("worker_id",), ranges: int | None = None) -> DataFrame:
    """Conversions before which the worker restarts: every ``n``-th; ``n`` = 0 never."""
    if n <= 0:
        return log.select(*keys, *TIME).filter(F.lit(False))
    out = over_ranges(log.select(*keys, *TIME), keys, TIME, lambda df, scan: scan.ordinal(df, "n"), ranges)
    return out.filter(F.col("n") % n == 0).select(*keys, *TIME)


def trailing_rate(log: DataFrame, seconds: int, keys: Sequence[str] = tuple(ROUTE), ranges: int | None = None) -> DataFrame:
    """Events per second over the last ``seconds``, both ends included, on every event.

    Events of a key at or before t, less those before t - ``seconds``: two prefix counts.  Every distinct time of a
    key and every time that far earlier is a row; one running count over ranges, in which the earlier
    times stand before events of the same microsecond, answers all look-ups, wherever they fall.
    """
    span = seconds * 1_000_000
    times = log.groupBy(*keys, "ts_us").agg(F.count(F.lit(1)).alias("_n"))
    row = lambda at, is_event, n: F.struct(at.alias("_at"), F.lit(is_event).alias("_event"), n.alias("_n"))
    rows = times.select(*keys, "ts_us", F.explode(F.array(row(F.col("ts_us"), 1, F.col("_n")), row(F.col("ts_us") - span, 0, F.lit(0).cast("bigint")))).alias("_r")).select(*keys, "ts_us", "_r.*")
    counted = over_ranges(rows, list(keys), ["_at", "_event"], lambda df, scan: scan.running(df, _before=("sum", F.col("_n"))), ranges)
    within = F.sum(F.when(F.col("_event") == 1, F.col("_before")).otherwise(-F.col("_before")))
    rates = counted.groupBy(*keys, "ts_us").agg((within / F.lit(float(seconds))).alias("rate"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*keys, "ts_us")]
    return log.select(*keys, *TIME).alias("l").join(rates.alias("r"), same).select(*[f"l.{c}" for c in (*keys, *TIME)], "rate")


def retry_outcome(attempts: DataFrame, key: str, attempt: str, ok: str, error: str, max_attempts: int) -> DataFrame:
    """One row per conversion: ok on any of the first ``max_attempts``, failed after all of them, else open."""
    a = attempts.filter(F.col(attempt) <= max_attempts)
    first_ok = F.min(F.when(F.col(ok), F.col(attempt)))
    out = a.groupBy(key).agg(first_ok.alias("_first"), F.max(attempt).alias("_last"), F.max_by(error, F.when(~F.col(ok), F.col(attempt))).alias("last_error"))
    return out.select(
        key,
        F.when(F.col("_first").isNotNull(), "ok").when(F.col("_last") >= max_attempts, "failed").otherwise("open").alias("outcome"),
        F.coalesce("_first", "_last").alias("attempts"),
        F.when(F.col("_first").isNull(), F.col("last_error")).alias("last_error"),
    )


def health_restarts(checks: DataFrame, keys: Sequence[str] = ("worker_id",), threshold: int = 3, ranges: int | None = None) -> DataFrame:
    """Checks at which a restart is made: after ``threshold`` failures in a row; the count then starts anew."""
    out = over_ranges(checks.select(*keys, *TIME, "ok"), keys, TIME, lambda df, scan: scan.count_since(df, n=(~F.col("ok"), F.col("ok"))), ranges)
    return out.filter(~F.col("ok") & (F.col("n") % threshold == 0)).select(*keys, *TIME)


# Summaries.


def health_rollup(checks: DataFrame, keys: Sequence[str], status: str = "status") -> DataFrame:
    bad = F.bool_or(F.col(status).isin(K.UNHEALTHY))
    return checks.groupBy(*keys).agg(F.when(bad, "unhealthy").otherwise("healthy").alias("status"))


def worker_summary(log: DataFrame) -> DataFrame:
    """Totals, averages, present and mean load, largest queue and average wait of each worker."""
    ok, n = F.col("ok"), F.count(F.lit(1))
    latest = lambda c: F.max_by(c, F.struct(*TIME))
    two = lambda c: F.round(c, 2)
    return log.groupBy("worker_id").agg(
        F.count_if(ok).alias("successes"),
        F.count_if(~ok).alias("failures"),
        two(F.count_if(~ok) * 100.0 / n).alias("error_rate_percent"),
        two(F.avg(F.when(ok, F.col("duration_ms")))).alias("avg_duration_ms"),
        two(latest("cpu_percent")).alias("current_cpu_percent"),
        two(F.avg("cpu_percent")).alias("avg_cpu_percent"),
        two(latest("memory_mb")).alias("current_memory_mb"),
        two(F.avg("memory_mb")).alias("avg_memory_mb"),
        F.max("queue_size").alias("max_queue_size"),
        two(F.sum("queue_ms") / n).alias("avg_queue_ms"),
    )


def uptime(log: DataFrame) -> DataFrame:
    """Seconds between a worker's last start (else its first row) and its last row."""
    start = F.coalesce(F.max(F.when(F.col("event") == "start", F.col("ts_us"))), F.min("ts_us"))
    return log.groupBy("worker_id").agg(((F.max("ts_us") - start) / 1_000_000).alias("uptime_s"))


def http_summary(requests: DataFrame, handler: Column, buckets: Sequence[float] = K.CONVERSION_BUCKETS) -> DataFrame:
    """Requests and durations per templated handler and exact status; other paths are ignored."""
    rows = requests.withColumn("handler", handler).filter(F.col("handler").isNotNull())
    return rows.groupBy("handler", "status").agg(F.count(F.lit(1)).alias("requests"), bucket_counts(F.col("duration_s"), buckets).alias("cumulative"))


def rejected_requests(requests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requests to protected paths without a valid key, and why.

    ``keys`` are SHA-256 digests of the configured API keys; none disables the check.
    A key in either header admits the request.  The digests sit in the expression, so
    there is no join.
    """
    if not keys:
        return requests.filter(F.lit(False)).withColumn("reason", F.lit("").cast("string"))
    given = F.array_compact(F.array(F.nullif(F.col("x_api_key"), F.lit("")), bearer_token("authorization")))
    known = F.array(*[F.lit(k) for k in keys])
    admitted = F.arrays_overlap(F.transform(given, lambda k: F.sha2(k, 256)), known)
    rows = requests.withColumn("reason", F.when(F.size(given) == 0, "missing API key").otherwise("invalid API key"))
    return rows.filter(protected_path("path") & ~F.coalesce(admitted, F.lit(False)))
