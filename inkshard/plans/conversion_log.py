"""Queries over the conversion, worker and request logs."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import functions as F

from inkshard.functions import constants as K
from inkshard.functions.policy import bad_option, route_error, route_steps, within_size
from inkshard.functions.text import error_line, in_range_or_default
from inkshard.operators import conversion_log as L
from inkshard.plans.registry import plan, table
from inkshard.plans.views import CONV_LOG, REQUEST_LOG, WORKER_LOG, conv_log, request_log, worker_log
from inkshard.sources.dims import formats_dim, lookup_dim, mime_type, output_name, paper_dim, unsupported_formats
from inkshard.sources.metrics import exposition_lines, gauge_lines, worker_exposition_lines

LOG = f"WITH log AS ({CONV_LOG})"


def _sql_buckets(buckets, alias="b"):
    rows = ", ".join(f"('{label}', {bound})" for label, bound in zip(L.bucket_labels(buckets), [*buckets, "'infinity'::DOUBLE"]))
    return f"(VALUES {rows}) {alias}(le, bound)"


def _sql_histogram(value: str, buckets, keys="", source="log"):
    k = f"{keys}, " if keys else ""
    group = f"GROUP BY {k}le, bound"
    return f"SELECT {k}le, bound, count(*) FILTER ({value} <= bound) AS cumulative, sum({value}) AS total, count({value}) AS n FROM {source}, {_sql_buckets(buckets)} {group}"


def _sql_quantile(q: float, value: str, buckets, keys: str, source="log"):
    """Quantile from buckets: first bucket reaching the rank, linear inside, open bucket answers its lower bound."""
    return f"""
    SELECT {keys}, CASE WHEN isinf(bound) THEN prev_bound ELSE prev_bound + (bound - prev_bound) * (n * {q} - prev_c) / nullif(cumulative - prev_c, 0) END AS p
    FROM (SELECT *, coalesce(lag(bound) OVER w, 0) AS prev_bound, coalesce(lag(cumulative) OVER w, 0) AS prev_c
          FROM ({_sql_histogram(value, buckets, keys, source)}) WINDOW w AS (PARTITION BY {keys} ORDER BY bound))
    WHERE cumulative >= n * {q} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY bound) = 1"""


@plan("s9_conversion_log", f"{LOG} SELECT event_id, ts_us, source_format, target_format, ok, duration_s, request_bytes, response_bytes, has_template FROM log")
def _(spark, sf):
    events = table(spark, sf, "events")
    by = lambda c, words, other: F.element_at(F.array(*[F.lit(w) for w in (*words, other)]), (c % (len(words) + 1) + 1).cast("int"))
    return L.conversion_log(
        events,
        "ts",
        source=by(F.col("user_id"), ("html", "docx"), "markdown"),
        target=by(F.col("event_id"), ("docx", "pdf", "pptx"), "html"),
        ok=F.col("event_type") != "error",
        duration_s=F.col("value") / 10,
        request_bytes=F.floor(F.col("value") * 10000).cast("bigint"),
        response_bytes=F.floor(F.col("value") * 25000).cast("bigint"),
        has_template=F.col("event_id") % 5 == 0,
    ).drop("ts")


@plan("a1_route_counters", f"{LOG} SELECT source_format, target_format, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures FROM log GROUP BY ALL")
def _(spark, sf):
    return L.route_counters(conv_log(spark, sf))


@plan("a2_template_counters", f"{LOG} SELECT target_format, count(*) AS conversions FROM log WHERE ok AND has_template GROUP BY ALL")
def _(spark, sf):
    return L.template_counters(conv_log(spark, sf))


@plan("a3_error_rate_percent", f"{LOG} SELECT source_format, target_format, round(count(*) FILTER (NOT ok) * 100.0 / count(*), 2) AS error_rate_percent FROM log GROUP BY ALL")
def _(spark, sf):
    return L.error_rate_percent(conv_log(spark, sf), *L.ROUTE, digits=2)


@plan("a4_error_ratio", f"{LOG} SELECT source_format, target_format, round(count(*) FILTER (NOT ok) * 100.0 / nullif(count(*) FILTER (ok), 0), 6) AS error_ratio FROM log GROUP BY ALL")
def _(spark, sf):
    return L.error_ratio(conv_log(spark, sf), *L.ROUTE).withColumn("error_ratio", F.round("error_ratio", 6))


@plan("a5_avg_duration", f"{LOG} SELECT target_format, round(avg(duration_s) FILTER (ok), 6) AS avg_seconds FROM log GROUP BY ALL")
def _(spark, sf):
    return L.avg_duration(conv_log(spark, sf), "target_format").withColumn("avg_seconds", F.round("avg_seconds", 6))


@plan("a6_histogram", f"{LOG}, h AS ({_sql_histogram('duration_s', K.CONVERSION_BUCKETS, 'source_format, target_format', '(FROM log WHERE ok)')}) SELECT source_format, target_format, le, cumulative, round(total, 4) AS sum, n AS count FROM h")
def _(spark, sf):
    log = conv_log(spark, sf).filter("ok")
    return L.histogram(log, "duration_s", K.CONVERSION_BUCKETS, L.ROUTE).withColumn("sum", F.round("sum", 4))


@plan(
    "a7_histogram_quantile",
    f"""{LOG}, done AS (SELECT * FROM log WHERE ok), p50 AS ({_sql_quantile(0.5, 'duration_s', K.CONVERSION_BUCKETS, 'target_format', 'done')}), p95 AS ({_sql_quantile(0.95, 'duration_s', K.CONVERSION_BUCKETS, 'target_format', 'done')})
    SELECT target_format, round(p50.p, 6) AS p50, round(p95.p, 6) AS p95 FROM p50 JOIN p95 USING (target_format)""",
)
def _(spark, sf):
    q = L.histogram_quantiles(conv_log(spark, sf).filter("ok"), "duration_s", K.CONVERSION_BUCKETS, [0.5, 0.95], ["target_format"])
    return q.withColumns({"p50": F.round("p50", 6), "p95": F.round("p95", 6)})


@plan(
    "a8_conversions_by_format",
    f"""{LOG} SELECT source_format, target_format, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures,
    CAST(grouping_id(source_format, target_format) AS BIGINT) AS level FROM log GROUP BY ROLLUP (source_format, target_format)""",
)
def _(spark, sf):
    return L.conversions_by_format(conv_log(spark, sf))


@plan(
    "a8_conversions_cube",
    f"""{LOG} SELECT source_format, target_format, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures,
    CAST(grouping_id(source_format, target_format) AS BIGINT) AS level FROM log GROUP BY CUBE (source_format, target_format)""",
)
def _(spark, sf):
    return L.conversions_by_format(conv_log(spark, sf), cube=True)


@plan(
    "a15_health_rollup",
    """SELECT CAST(user_id % 7 AS BIGINT) AS worker_id, CASE WHEN bool_or(CASE event_id % 401 WHEN 0 THEN 'unavailable' WHEN 1 THEN 'disabled' ELSE 'available' END = 'unavailable' AND user_id % 7 < 4) THEN 'unhealthy' ELSE 'healthy' END AS status
    FROM events GROUP BY 1""",
)
def _(spark, sf):
    state = "CASE WHEN event_id % 401 = 0 AND user_id % 7 < 4 THEN 'unavailable' WHEN event_id % 401 = 1 THEN 'disabled' ELSE 'available' END AS status"
    return L.health_rollup(table(spark, sf, "events").selectExpr("user_id % 7 AS worker_id", state), ["worker_id"])


@plan(
    "a16_worker_summary",
    f"""WITH w AS ({WORKER_LOG}) SELECT worker_id, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures,
    round(count(*) FILTER (NOT ok) * 100.0 / count(*), 2) AS error_rate_percent, round(avg(duration_ms) FILTER (ok), 2) AS avg_duration_ms,
    round(arg_max(cpu_percent, event_id), 2) AS current_cpu_percent, round(avg(cpu_percent), 2) AS avg_cpu_percent,
    round(arg_max(memory_mb, event_id), 2) AS current_memory_mb, round(avg(memory_mb), 2) AS avg_memory_mb,
    max(queue_size) AS max_queue_size, round(sum(queue_ms) / count(*), 2) AS avg_queue_ms FROM w GROUP BY worker_id""",
)
def _(spark, sf):
    return L.worker_summary(worker_log(spark, sf))


@plan(
    "a17_size_profile",
    f"""{LOG}, s AS (SELECT 'request_bytes' AS side, request_bytes AS v FROM log UNION ALL SELECT 'response_bytes', response_bytes FROM log),
    p AS ({_sql_quantile(0.95, 'v', K.SIZE_BUCKETS, 'side', 's')}), h AS ({_sql_histogram('v', K.SIZE_BUCKETS, 'side', 's')})
    SELECT side, le, cumulative, round(p.p, 4) AS p95 FROM h JOIN p USING (side)""",
)
def _(spark, sf):
    return L.size_profile(conv_log(spark, sf)).withColumn("p95", F.round("p95", 4))


@plan(
    "a20_uptime",
    f"""WITH w AS ({WORKER_LOG}) SELECT worker_id, (max(ts_us) - coalesce(max(ts_us) FILTER (event = 'start'), min(ts_us))) / 1000000 AS uptime_s FROM w GROUP BY worker_id""",
)
def _(spark, sf):
    return L.uptime(worker_log(spark, sf))


_HANDLER = "CASE WHEN path LIKE '/convert/%' THEN '/convert/{source}/to/{target}' WHEN path = '/docx-template/' THEN '/docx-template' END"


@plan(
    "a21_http_summary",
    f"""WITH r AS ({REQUEST_LOG}), h AS ({_sql_histogram('duration_s', K.CONVERSION_BUCKETS, 'handler, status', f"(SELECT *, {_HANDLER} AS handler FROM r WHERE {_HANDLER} IS NOT NULL)")})
    SELECT handler, status, le, cumulative, n AS requests FROM h""",
)
def _(spark, sf):
    wide = L.http_summary(request_log(spark, sf), F.expr(_HANDLER))
    labels = F.array(*[F.lit(x) for x in L.bucket_labels(K.CONVERSION_BUCKETS)])
    rows = wide.select("handler", "status", "requests", F.explode(F.arrays_zip(labels.alias("le"), F.col("cumulative").alias("n"))).alias("b"))
    return rows.select("handler", "status", "requests", "b.le", F.col("b.n").alias("cumulative"))


_STREAKS = """SELECT worker_id, event_id, ts_us, ok, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY worker_id ORDER BY ts_us, event_id) AS streak FROM log"""


@plan(
    "w10_failure_streaks",
    f"""{LOG}, s AS ({_STREAKS}) SELECT worker_id, event_id, ts_us, row_number() OVER (PARTITION BY worker_id, streak ORDER BY ts_us, event_id) AS streak_pos
    FROM s WHERE NOT ok""",
)
def _(spark, sf):
    return L.failure_streaks(conv_log(spark, sf))


@plan("w10_streak_lengths", f"{LOG}, s AS ({_STREAKS}) SELECT worker_id, min(ts_us) AS start_us, count(*) AS length FROM s WHERE NOT ok GROUP BY worker_id, streak")
def _(spark, sf):
    return L.streak_lengths(conv_log(spark, sf))


_ACTIVE = """e AS (SELECT event_id, ts_us AS t_us, 1 AS delta FROM log UNION ALL SELECT event_id, ts_us + CAST(floor(busy_s * 1000000) AS BIGINT), -1 FROM log),
 s AS (SELECT *, sum(delta) OVER (ORDER BY t_us, delta, event_id) AS s FROM e),
 a AS (SELECT event_id, t_us, delta, s - least(0, min(s) OVER (ORDER BY t_us, delta, event_id)) AS active FROM s)"""


@plan("w11_active_conversions", f"{LOG}, {_ACTIVE} SELECT event_id, t_us, delta, CAST(active AS BIGINT) AS active FROM a")
def _(spark, sf):
    return L.active_conversions(conv_log(spark, sf))


@plan("w11_peak_active", f"{LOG}, {_ACTIVE} SELECT t_us // 3600000000 * 3600000000 AS from_us, CAST(max(active) AS BIGINT) AS peak FROM a GROUP BY 1")
def _(spark, sf):
    return L.peak_active(L.active_conversions(conv_log(spark, sf)), 3_600_000_000)


@plan("w12_restart_points", f"{LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY worker_id ORDER BY ts_us, event_id) AS n FROM log) SELECT worker_id, ts_us, event_id FROM n WHERE n % 50 = 0")
def _(spark, sf):
    return L.restart_points(conv_log(spark, sf), 50)


def _rate_sql(seconds):
    return f"""{LOG} SELECT source_format, target_format, event_id, ts_us,
    round(count(*) OVER (PARTITION BY source_format, target_format ORDER BY ts_us RANGE BETWEEN {seconds}000000 PRECEDING AND CURRENT ROW) / {float(seconds)}, 9) AS rate FROM log"""


@plan("w13_rate_5m", _rate_sql(300))
def _(spark, sf):
    return L.trailing_rate(conv_log(spark, sf), 300).withColumn("rate", F.round("rate", 9))


@plan("w13_rate_1h", _rate_sql(3600))
def _(spark, sf):
    return L.trailing_rate(conv_log(spark, sf), 3600).withColumn("rate", F.round("rate", 9))


@plan(
    "w17_retry_outcome",
    """WITH a AS (SELECT event_id // 3 AS request_id, event_id % 3 + 1 AS attempt, event_type NOT IN ('error', 'click') AS ok, concat(event_type, ' ', CAST(event_id AS VARCHAR)) AS error FROM events),
    g AS (SELECT request_id, min(attempt) FILTER (ok) AS f, max(attempt) AS l, arg_max(error, attempt) FILTER (NOT ok) AS e FROM a WHERE attempt <= 2 GROUP BY 1)
    SELECT request_id, CASE WHEN f IS NOT NULL THEN 'ok' WHEN l >= 2 THEN 'failed' ELSE 'open' END AS outcome, coalesce(f, l) AS attempts, CASE WHEN f IS NULL THEN e END AS last_error FROM g""",
)
def _(spark, sf):
    attempts = table(spark, sf, "events").selectExpr(
        "event_id DIV 3 AS request_id", "event_id % 3 + 1 AS attempt", "event_type NOT IN ('error', 'click') AS ok", "concat(event_type, ' ', CAST(event_id AS STRING)) AS error"
    )
    return L.retry_outcome(attempts, "request_id", "attempt", "ok", "error", 2)


@plan(
    "w18_health_restarts",
    f"""{LOG}, s AS ({_STREAKS}), p AS (SELECT *, row_number() OVER (PARTITION BY worker_id, streak ORDER BY ts_us, event_id) AS p FROM s WHERE NOT ok)
    SELECT worker_id, ts_us, event_id FROM p WHERE p % 3 = 0""",
)
def _(spark, sf):
    return L.health_restarts(conv_log(spark, sf))


_KEYS = ("key-0", "key-3", "key-6")
_PROTECTED = "(regexp_replace(path, '/+$', '') IN ('/docx-template', '/pptx-template') OR path LIKE '/convert/%')"


@plan(
    "j7_rejected_requests",
    f"""WITH r AS (SELECT *, CASE WHEN lower(split_part("authorization", ' ', 1)) = 'bearer' THEN trim(substr("authorization", strpos("authorization", ' ') + 1)) END AS bearer
    FROM ({REQUEST_LOG.replace("AS authorization", 'AS "authorization"')}))
    SELECT event_id, path, CASE WHEN x_api_key IS NULL AND bearer IS NULL THEN 'missing API key' ELSE 'invalid API key' END AS reason
    FROM r WHERE {_PROTECTED} AND NOT (coalesce(x_api_key, '') IN {_KEYS} OR coalesce(bearer, '') IN {_KEYS})""",
)
def _(spark, sf):
    digests = [sha256(k.encode()).hexdigest() for k in _KEYS]
    return L.rejected_requests(request_log(spark, sf), digests).select("event_id", "path", "reason")


def _sql_family(name: str, value: str, buckets, keys: str = "", source: str = "log") -> str:
    """Bucket, count and sum lines of a histogram."""
    labels = " || ',' || ".join(f"'{k}=\"' || {k} || '\"'" for k in keys.split(", ") if k)
    inside, alone = (f"{labels} || ',", f"'{{' || {labels} || '}}'") if labels else ("'", "''")
    h = f"({_sql_histogram(value, buckets, keys, source)})"
    return f"""SELECT '{name}_bucket{{' || {inside}le="' || le || '"}} ' || cumulative AS value FROM {h}
    UNION ALL SELECT '{name}_count' || {alone} || ' ' || n FROM {h} WHERE le = '+Inf' UNION ALL SELECT '{name}_sum' || {alone} || ' ' || printf('%.3f', CAST(total AS DOUBLE)) FROM {h} WHERE le = '+Inf'"""


_TIMES = ["duration_s * 0.7391 AS subprocess_s", "duration_s / 16 AS post_s"]
_TIMED = f"{LOG}, timed AS (SELECT *, {', '.join(_TIMES)} FROM log), done AS (SELECT * FROM timed WHERE ok)"


@plan(
    "s10_exposition_lines",
    f"""{_TIMED}, c AS (SELECT source_format AS s, target_format AS t, count(*) FILTER (ok) AS n, count(*) FILTER (NOT ok) AS f FROM log GROUP BY ALL)
    SELECT 'conversions_total{{source_format="' || s || '",target_format="' || t || '"}} ' || n AS value FROM c
    UNION ALL SELECT 'conversion_failures_total{{source_format="' || s || '",target_format="' || t || '"}} ' || f FROM c
    UNION ALL SELECT 'template_conversions_total{{target_format="' || target_format || '"}} ' || count(*) FILTER (ok AND has_template) FROM log GROUP BY target_format
    UNION ALL {_sql_family('conversion_duration_seconds', 'duration_s', K.CONVERSION_BUCKETS, 'source_format, target_format', 'done')}
    UNION ALL {_sql_family('subprocess_duration_seconds', 'subprocess_s', K.SUBPROCESS_BUCKETS, '', 'done')}
    UNION ALL {_sql_family('post_processing_duration_seconds', 'post_s', K.POST_PROCESSING_BUCKETS, 'target_format', 'done')}
    UNION ALL {_sql_family('request_body_bytes', 'request_bytes', K.SIZE_BUCKETS)} UNION ALL {_sql_family('response_body_bytes', 'response_bytes', K.SIZE_BUCKETS)}
    UNION ALL SELECT 'conversion_error_rate_percent ' || printf('%.3f', count(*) FILTER (NOT ok) * 100.0 / count(*)) FROM log
    UNION ALL SELECT 'avg_conversion_time_seconds ' || printf('%.3f', avg(duration_s)) FROM done""",
)
def _(spark, sf):
    return exposition_lines(conv_log(spark, sf).selectExpr("*", *_TIMES))


@plan(
    "s10_worker_exposition_lines",
    f"""WITH w AS (SELECT *, duration_ms / 1000 AS seconds FROM ({WORKER_LOG})), done AS (SELECT * FROM w WHERE ok)
    SELECT 'raster_conversions_total ' || count(*) AS value FROM done UNION ALL SELECT 'raster_conversion_failures_total ' || count(*) FROM w WHERE NOT ok
    UNION ALL SELECT 'worker_restarts_total{{worker="' || worker_id || '"}} ' || count(*) FILTER (event = 'start') FROM w GROUP BY worker_id
    UNION ALL {_sql_family('raster_duration_seconds', 'seconds', K.RASTER_BUCKETS, '', 'done')}
    UNION ALL SELECT 'raster_conversion_error_rate_percent ' || printf('%.3f', count(*) FILTER (NOT ok) * 100.0 / count(*)) FROM w
    UNION ALL SELECT 'avg_raster_conversion_time_seconds ' || printf('%.3f', avg(seconds)) FROM done UNION ALL SELECT 'avg_queue_wait_seconds ' || printf('%.3f', avg(queue_ms / 1000)) FROM w
    UNION ALL SELECT 'avg_cpu_percent ' || printf('%.3f', avg(cpu_percent)) FROM w UNION ALL SELECT 'avg_memory_mb ' || printf('%.3f', avg(memory_mb)) FROM w""",
)
def _(spark, sf):
    return worker_exposition_lines(worker_log(spark, sf))


def _gauge(name: str, number: str) -> str:
    return f"""SELECT '{name}{{worker="' || worker_id || '"}} ' || {number} AS value FROM g"""


@plan(
    "s10_gauge_lines",
    f"""WITH w AS ({WORKER_LOG}), l AS (SELECT worker_id, max(ts_us) AS now_us, min(ts_us) AS from_us, max(ts_us) FILTER (event = 'start') AS start_us,
      max(row(ts_us, event_id)) FILTER (ok) AS ok_at, arg_max(cpu_percent, row(ts_us, event_id)) AS cpu, arg_max(memory_mb, row(ts_us, event_id)) AS mb, arg_max(queue_size, row(ts_us, event_id)) AS queue FROM w GROUP BY worker_id),
    g AS (SELECT l.*, n.failures, n.active FROM l JOIN (SELECT worker_id, count(*) FILTER (NOT ok AND (ok_at IS NULL OR row(ts_us, event_id) > ok_at)) AS failures, count(*) FILTER (ts_us + CAST(floor(duration_ms * 1000) AS BIGINT) > now_us) AS active
      FROM w JOIN l USING (worker_id) GROUP BY worker_id) n USING (worker_id))
    {_gauge('worker_uptime_seconds', "printf('%.3f', (now_us - coalesce(start_us, from_us)) / 1000000)")} UNION ALL {_gauge('worker_consecutive_failures', 'failures')}
    UNION ALL {_gauge('worker_cpu_percent', "printf('%.3f', cpu)")} UNION ALL {_gauge('worker_memory_bytes', 'CAST(floor(mb * 1048576) AS BIGINT)')}
    UNION ALL {_gauge('worker_queue_size', 'queue')} UNION ALL {_gauge('worker_active_conversions', 'active')}
    UNION ALL SELECT 'active_conversions ' || CAST(sum(active) AS BIGINT) FROM g UNION ALL SELECT 'uptime_seconds ' || printf('%.3f', (max(now_us) - min(from_us)) / 1000000) FROM g
    UNION ALL SELECT 'service_info{{version="1"}} 1'""",
)
def _(spark, sf):
    return gauge_lines(worker_log(spark, sf), {"version": "1"})


def _family_plan(name: str, columns: list[str], value: str, buckets, keys: list[str]):
    """A histogram over successes, per family and bucket layout."""
    k = ", ".join(keys)
    k_ = f"{k}, " if k else ""

    @plan(name, f"{_TIMED}, h AS ({_sql_histogram(value, buckets, k, 'done')}) SELECT {k_}le, cumulative, round(total, 4) AS sum, n AS count FROM h")
    def _(spark, sf):
        log = conv_log(spark, sf).selectExpr("*", *columns).filter("ok")
        return L.histogram(log, value, buckets, keys).withColumn("sum", F.round("sum", 4))


_family_plan("a6_subprocess_histogram", _TIMES, "subprocess_s", K.SUBPROCESS_BUCKETS, [])
_family_plan("a6_post_processing_histogram", _TIMES, "post_s", K.POST_PROCESSING_BUCKETS, ["target_format"])


@plan(
    "a6_raster_histogram",
    f"WITH w AS (SELECT worker_id, duration_ms / 1000 AS seconds FROM ({WORKER_LOG}) WHERE ok), h AS ({_sql_histogram('seconds', K.RASTER_BUCKETS, 'worker_id', 'w')}) SELECT worker_id, le, cumulative, round(total, 4) AS sum, n AS count FROM h",
)
def _(spark, sf):
    log = worker_log(spark, sf).filter("ok").withColumn("seconds", F.col("duration_ms") / 1000)
    return L.histogram(log, "seconds", K.RASTER_BUCKETS, ["worker_id"]).withColumn("sum", F.round("sum", 4))


# Policies applied to the log.

_MESSY = """CASE event_id % 11 WHEN 0 THEN 'doc/x' WHEN 1 THEN 'odt' WHEN 2 THEN 'xls' ELSE source_format END"""
_MESSY_TARGET = """CASE event_id % 13 WHEN 0 THEN '' WHEN 1 THEN 'docm' WHEN 2 THEN 'p df' ELSE target_format END"""


def _in(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@plan(
    "p1_valid_route",
    f"""{LOG}, m AS (SELECT {_MESSY} AS s, {_MESSY_TARGET} AS t FROM log)
    SELECT s AS source_format, t AS target_format, CASE WHEN NOT (regexp_matches(s, '^[\\p{{L}}\\p{{N}}]+$') AND regexp_matches(t, '^[\\p{{L}}\\p{{N}}]+$')) THEN 'Format parameters must be alphanumeric'
      WHEN s NOT IN {_in(K.SOURCE_FORMATS)} THEN 'Invalid source format: ' || s WHEN t NOT IN {_in(K.TARGET_FORMATS)} THEN 'Invalid target format: ' || t END AS error, count(*) AS n
    FROM m GROUP BY ALL""",
)
def _(spark, sf):
    log = conv_log(spark, sf).selectExpr(f"{_MESSY} AS source_format", f"{_MESSY_TARGET} AS target_format")
    return log.groupBy("source_format", "target_format", route_error("source_format", "target_format").alias("error")).agg(F.count(F.lit(1)).alias("n"))


@plan(
    "p2_valid_options",
    """SELECT event_id, CASE WHEN user_id % 5 = 0 THEN '--filter=' || event_type WHEN user_id % 5 = 1 THEN '--toc=1' END AS bad FROM events""",
)
def _(spark, sf):
    third = "CASE user_id % 5 WHEN 0 THEN concat('--filter=', event_type) WHEN 1 THEN '--toc=1' WHEN 2 THEN '--reference-doc=a b.docx' WHEN 3 THEN '--toc' ELSE '--track-changes=all' END"
    events = table(spark, sf, "events").selectExpr("event_id", f"array('--toc', '--reference-doc=', {third}, CASE WHEN user_id % 5 < 2 THEN '--bad' ELSE '--toc' END) AS options")
    return events.select("event_id", bad_option("options").alias("bad"))


@plan("p3_within_size", "SELECT page_id AS doc_id, octet_length(encode(html)) <= 1048576 * 1 AS ok, octet_length(encode(html)) AS bytes FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), within_size("html", 1).alias("ok"), F.octet_length("html").cast("bigint").alias("bytes"))


_STEPS_SQL = """concat_ws(',',
 CASE WHEN s = 'docx' AND t IN ('latex', 'pdf') THEN 'docx_latex_rewrite' END,
 CASE WHEN s = 'html' AND t = 'docx' THEN 'list_rewrite,paragraph_rewrite,math_color_rewrite,image_rewrite' END,
 'sandbox',
 CASE WHEN t IN ('latex', 'pdf') THEN 'strip_raw_tex,strip_document_images' END,
 CASE WHEN s = 'html' AND t = 'docx' THEN 'inline_styles,html_lists,html_captions' END,
 CASE WHEN s = 'html' AND t = 'docx' AND p THEN 'preserve_table_styles' END,
 CASE WHEN s = 'html' AND t IN ('latex', 'pdf') THEN 'html_tables_to_latex' END,
 CASE WHEN s = 'docx' AND t IN ('latex', 'pdf') THEN 'docx_text_decorations,docx_colors_to_latex,docx_math_colors_to_latex,docx_paragraphs_to_latex,docx_lists_to_latex,docx_tables_to_latex,docx_caption_labels_to_latex' END)"""


@plan("j8_conversion_routes", f"{LOG}, r AS (SELECT source_format AS s, target_format AS t, has_template AS p, count(*) AS n FROM log GROUP BY ALL) SELECT s AS source_format, t AS target_format, p AS has_template, n, {_STEPS_SQL} AS steps FROM r")
def _(spark, sf):
    routes = conv_log(spark, sf).groupBy(*L.ROUTE, "has_template").agg(F.count(F.lit(1)).alias("n"))
    return routes.withColumn("steps", F.array_join(route_steps("source_format", "target_format", F.lit(True), F.col("has_template")), ","))


def _case(key, mapping, other):
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE '{other}' END"


@plan(
    "s8_format_dims",
    f"""{LOG} SELECT target_format, {_case('target_format', K.MIME_TYPES, K.DEFAULT_MIME_TYPE)} AS mime_type, 'converted-document.' || {_case('target_format', K.FILE_EXTENSIONS, K.DEFAULT_EXTENSION)} AS file_name,
    target_format IN {_in(K.SOURCE_FORMATS)} AS is_source, count(*) AS n FROM log GROUP BY ALL""",
)
def _(spark, sf):
    counts = conv_log(spark, sf).groupBy("target_format").agg(F.count(F.lit(1)).alias("n"))
    named = counts.withColumns({"mime_type": mime_type("target_format"), "file_name": output_name("target_format")})
    return lookup_dim(named, formats_dim(spark), "target_format", "format").drop("is_target")


@plan(
    "u3_unsupported_formats",
    f"""{LOG}, s AS (SELECT DISTINCT source_format AS format FROM log), t AS (SELECT DISTINCT target_format AS format FROM log)
    SELECT format, 'source_only' AS side FROM (SELECT * FROM s EXCEPT SELECT * FROM t) UNION ALL SELECT format, 'target_only' FROM (SELECT * FROM t EXCEPT SELECT * FROM s)
    UNION ALL SELECT format, 'both' FROM (SELECT * FROM s INTERSECT SELECT * FROM t)""",
)
def _(spark, sf):
    log = conv_log(spark, sf)
    return unsupported_formats(log.select(F.col("source_format").alias("format")), log.select(F.col("target_format").alias("format")))


@plan(
    "j3_lookup_dim",
    f"""WITH p AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a4' WHEN 1 THEN 'Letter' WHEN 2 THEN 'b9' END AS paper FROM events)
    SELECT event_id, paper, CASE upper(paper) WHEN 'A4' THEN {K.PAPER_TWIPS['A4'][0]} WHEN 'LETTER' THEN {K.PAPER_TWIPS['LETTER'][0]} END AS w,
      CASE upper(paper) WHEN 'A4' THEN {K.PAPER_TWIPS['A4'][1]} WHEN 'LETTER' THEN {K.PAPER_TWIPS['LETTER'][1]} END AS h FROM p""",
)
def _(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", "CASE event_id % 4 WHEN 0 THEN 'a4' WHEN 1 THEN 'Letter' WHEN 2 THEN 'b9' END AS paper")
    known = lookup_dim(rows.filter("paper <> 'b9' OR paper IS NULL"), paper_dim(spark), "paper", "paper", strict=True)
    return known.unionByName(lookup_dim(rows.filter("paper = 'b9'"), paper_dim(spark), "paper", "paper"))


@plan("f34_in_range_or_default", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 30 WHEN CAST(floor(value) AS INT) BETWEEN 5 AND 300 THEN CAST(floor(value) AS INT) ELSE 30 END AS timeout_s FROM events")
def _(spark, sf):
    raw = F.when(F.col("event_id") % 9 == 0, "soon").otherwise(F.floor("value").cast("string"))
    return table(spark, sf, "events").select("event_id", in_range_or_default(raw, 5, 300, 30).alias("timeout_s"))


@plan("f35_error_line", r"SELECT conv_id, turn, replace(replace(text, chr(13) || chr(10), ''), chr(10), '') AS line FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", error_line("text").alias("line"))
