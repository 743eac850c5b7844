"""Conversion metrics written as exposition text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkshard.functions import constants as K
from inkshard.operators.conversion_log import ROUTE, bucket_counts, bucket_labels


def _families(df: DataFrame, keys: list[str], counters: dict, histograms: dict, gauges: dict) -> DataFrame:
    """``value`` lines of several families from one pass over ``df``.

    ``counters``: name to (labels, number); ``histograms``: name to (labels, value, buckets); ``gauges``: name to
    (numerator, denominator).  Labels are among ``keys``: rows are aggregated by all keys once, and
    families with fewer labels are summed from those few rows.
    """
    sums = [n.alias(f"c_{name}") for name, (_, n) in counters.items()]
    sums += [x.alias(f"g_{name}_{i}") for name, parts in gauges.items() for i, x in enumerate(parts)]
    for name, (_, value, buckets) in histograms.items():
        sums += [bucket_counts(value, buckets).alias(f"h_{name}"), F.coalesce(F.sum(value), F.lit(0.0)).alias(f"s_{name}")]
    wide = df.groupBy(*keys).agg(*sums)

    def sample(metric: str, labels: list[str], le: str | None, number: Column, divisor: Column | None, decimals: bool) -> Column:
        pairs = [F.concat(F.lit(f'{k}="'), F.col(k), F.lit('"')) for k in labels] + ([F.lit(f'le="{le}"')] if le else [])
        text = F.concat_ws(",", *pairs) if pairs else F.lit("")
        return F.struct(
            F.lit(metric).alias("metric"), text.alias("labels"), number.cast("double").alias("number"), (F.lit(None) if divisor is None else divisor).cast("double").alias("divisor"), F.lit(decimals).alias("decimals")
        )

    rows = [sample(name, labels, None, F.col(f"c_{name}"), None, False) for name, (labels, _) in counters.items()]
    rows += [sample(name, [], None, F.col(f"g_{name}_0"), F.col(f"g_{name}_1"), True) for name in gauges]
    for name, (labels, _, buckets) in histograms.items():
        count = F.get(f"h_{name}", F.lit(len(buckets)))
        lines = [sample(f"{name}_bucket", labels, le, F.get(f"h_{name}", F.lit(i)), None, False) for i, le in enumerate(bucket_labels(buckets))]
        lines += [sample(f"{name}_count", labels, None, count, None, False), sample(f"{name}_sum", labels, None, F.col(f"s_{name}"), None, True)]
        # Nothing observed, no histogram yet.
        rows += [F.when(count > 0, line) for line in lines]
    long = wide.select(F.explode(F.array_compact(F.array(*rows))).alias("r")).select("r.*")
    totals = long.groupBy("metric", "labels", "decimals").agg(F.sum("number").alias("number"), F.sum("divisor").alias("divisor"))
    number = F.when(F.col("divisor").isNull(), F.col("number")).when(F.col("divisor") == 0, 0.0).otherwise(F.col("number") / F.col("divisor"))
    name = F.when(F.col("labels") == "", F.col("metric")).otherwise(F.concat("metric", F.lit("{"), "labels", F.lit("}")))
    return totals.select(F.concat(name, F.lit(" "), F.when(F.col("decimals"), F.format_string("%.3f", number)).otherwise(number.cast("bigint").cast("string"))).alias("value"))


def exposition_lines(log: DataFrame) -> DataFrame:
    """One row ``value`` for each sample of the conversion families, from one pass over the log.

    Durations, sub-process and post-processing times (``duration_s``, ``subprocess_s``, ``post_s``; the last two where the
    log has them) count successes only; sizes count every conversion.
    """
    ok = F.col("ok")
    done = lambda c: F.when(ok, F.col(c))
    counters = {
        "conversions_total": (ROUTE, F.count_if(ok)),
        "conversion_failures_total": (ROUTE, F.count_if(~ok)),
        "template_conversions_total": (["target_format"], F.count_if(ok & F.col("has_template"))),
    }
    histograms = {"conversion_duration_seconds": (ROUTE, done("duration_s"), K.CONVERSION_BUCKETS)}
    if "subprocess_s" in log.columns:
        histograms["subprocess_duration_seconds"] = ([], done("subprocess_s"), K.SUBPROCESS_BUCKETS)
    if "post_s" in log.columns:
        histograms["post_processing_duration_seconds"] = (["target_format"], done("post_s"), K.POST_PROCESSING_BUCKETS)
    histograms |= {f"{side}_body_bytes": ([], F.col(f"{side}_bytes"), K.SIZE_BUCKETS) for side in ("request", "response")}
    gauges = {
        "conversion_error_rate_percent": (F.count_if(~ok) * 100, F.count(F.lit(1))),
        "avg_conversion_time_seconds": (F.sum(done("duration_s")), F.count_if(ok)),
    }
    return _families(log, list(ROUTE), counters, histograms, gauges)


def worker_exposition_lines(log: DataFrame) -> DataFrame:
    """The families of the workers that turn drawings into rasters, from one pass over the worker log."""
    ok, seconds = F.col("ok"), F.when(F.col("ok"), F.col("duration_ms") / 1000)
    counters = {
        "raster_conversions_total": ([], F.count_if(ok)),
        "raster_conversion_failures_total": ([], F.count_if(~ok)),
        "worker_restarts_total": (["worker"], F.count_if(F.col("event") == "start")),
    }
    gauges = {
        "raster_conversion_error_rate_percent": (F.count_if(~ok) * 100, F.count(F.lit(1))),
        "avg_raster_conversion_time_seconds": (F.sum(seconds), F.count_if(ok)),
        "avg_queue_wait_seconds": (F.sum(F.col("queue_ms") / 1000), F.count("queue_ms")),
        "avg_cpu_percent": (F.sum("cpu_percent"), F.count("cpu_percent")),
        "avg_memory_mb": (F.sum("memory_mb"), F.count("memory_mb")),
    }
    histograms = {"raster_duration_seconds": ([], seconds, K.RASTER_BUCKETS)}
    return _families(log.withColumn("worker", F.col("worker_id").cast("string")), ["worker"], counters, histograms, gauges)


def gauge_lines(log: DataFrame, info: Mapping[str, str] = {}) -> DataFrame:
    """One row ``value`` for each gauge of the present state, read at the end of a worker log.

    Per worker, at its last row: seconds since its last start (else its first row), failures since its last success,
    load and waiting requests as that row states them, and conversions in flight: begun and not yet over at that
    time.  For all: seconds from the first row to the last, conversions in flight over all workers, and ``info`` as
    labels of a constant line.  A load that is null gives no line, and rows without a worker count nowhere.  An empty log gives the ``info`` line only.

    The last rows are one row for each worker, combined map-side; the log meets them once more to be counted.
    """
    at = F.struct("ts_us", "event_id")
    ok_at = F.max(F.when(F.col("ok"), at)).alias("ok_at")
    latest = [F.max_by(c, at).alias(c) for c in ("cpu_percent", "memory_mb", "queue_size")]
    last = log.groupBy("worker_id").agg(F.max("ts_us").alias("now_us"), F.min("ts_us").alias("from_us"), F.max(F.when(F.col("event") == "start", F.col("ts_us"))).alias("start_us"), ok_at, *latest)
    rows = log.select("worker_id", "ts_us", at.alias("at"), "ok", "duration_ms").join(last, "worker_id")
    over = F.col("ts_us") + F.floor(F.col("duration_ms") * 1000).cast("bigint")
    counted = rows.groupBy(*last.columns).agg(
        F.count_if(~F.col("ok") & F.coalesce(F.col("at") > F.col("ok_at"), F.lit(True))).alias("failures"), F.count_if(over > F.col("now_us")).alias("active")
    )
    worker = F.concat(F.lit('{worker="'), F.col("worker_id").cast("string"), F.lit('"}'))
    seconds = lambda us: F.format_string("%.3f", us / 1_000_000)
    line = lambda name, labels, number: F.concat(F.lit(name), labels, F.lit(" "), number)
    whole = lambda c: F.col(c).cast("bigint").cast("string")
    mine = [
        line("worker_uptime_seconds", worker, seconds(F.col("now_us") - F.coalesce("start_us", "from_us"))),
        line("worker_consecutive_failures", worker, whole("failures")),
        line("worker_cpu_percent", worker, F.format_string("%.3f", F.when(F.col("cpu_percent").isNotNull(), F.col("cpu_percent")))),
        line("worker_memory_bytes", worker, F.floor(F.col("memory_mb") * 1048576).cast("bigint").cast("string")),
        line("worker_queue_size", worker, whole("queue_size")),
        line("worker_active_conversions", worker, whole("active")),
    ]
    mine[2] = F.when(F.col("cpu_percent").isNotNull(), mine[2])
    total = counted.agg(F.sum("active").alias("active"), F.max("now_us").alias("now_us"), F.min("from_us").alias("from_us")).filter("now_us IS NOT NULL")
    ours = [line("active_conversions", F.lit(""), whole("active")), line("uptime_seconds", F.lit(""), seconds(F.col("now_us") - F.col("from_us")))]
    lines = [df.select(F.explode(F.array_compact(F.array(*parts))).alias("value")) for df, parts in ((counted, mine), (total, ours))]
    labels = ",".join(f'{k}="{v}"' for k, v in sorted(info.items()))
    return lines[0].unionByName(lines[1]).unionByName(log.sparkSession.createDataFrame([(f"service_info{{{labels}}} 1",)] if info else [], "value string"))


def write_exposition(log: DataFrame, path: str) -> None:
    exposition_lines(log).write.mode("overwrite").text(path)
