"""Views the queries run on, derived from the benchmark tables, for Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkshard.operators.ordered import over_groups
from inkshard.plans.registry import table

_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "_ship"]

CONV_LOG_COLUMNS = """
CASE user_id % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'docx' ELSE 'markdown' END AS source_format,
CASE event_id % 4 WHEN 0 THEN 'docx' WHEN 1 THEN 'pdf' WHEN 2 THEN 'pptx' ELSE 'html' END AS target_format,
event_type <> 'error' AS ok,
value / 10 AS duration_s,
value * 10 AS busy_s,
CAST(floor(value * 10000) AS BIGINT) AS request_bytes,
CAST(floor(value * 25000) AS BIGINT) AS response_bytes,
event_id % 5 = 0 AS has_template,
user_id % 7 AS worker_id
""".strip().split(",\n")


def conv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversion; ``ts_us`` is its start in epoch microseconds."""
    return table(spark, sf_dir, "events").selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS ts", "unix_micros(CAST(ts AS TIMESTAMP)) AS ts_us", *CONV_LOG_COLUMNS)


CONV_LOG = "SELECT event_id, ts, epoch_us(ts) AS ts_us, " + ", ".join(CONV_LOG_COLUMNS) + " FROM events"

REQUEST_COLUMNS = [
    "event_id",
    "CASE event_id % 4 WHEN 0 THEN '/convert/html/to/docx' WHEN 1 THEN '/docx-template/' WHEN 2 THEN '/health' ELSE '/convert/docx/to/pdf' END AS path",
    "CASE WHEN user_id % 3 = 0 THEN concat('key-', CAST(user_id % 10 AS STRING)) ELSE NULL END AS x_api_key",
    "CASE WHEN user_id % 4 = 0 THEN concat('Bearer key-', CAST(event_id % 10 AS STRING)) ELSE NULL END AS authorization",
    "value / 10 AS duration_s",
    "CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 ELSE 200 END AS status",
]
REQUEST_LOG = "SELECT " + ", ".join(REQUEST_COLUMNS) + " FROM events"


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*REQUEST_COLUMNS)


def lines(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """lineitem with ``pos``, the running number of a line in its order."""
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", *extra]
    lines = table(spark, sf_dir, "lineitem").select(*columns, F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("_ship"))
    return over_groups(lines, ["l_orderkey"], _LINE_ORDER, lambda df, scan: scan.ordinal(df, "pos")).drop("_ship")


_POS = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)"

BLOCK_COLUMNS = [
    "CASE l_returnflag WHEN 'R' THEN 'caption' WHEN 'A' THEN 'table' ELSE 'para' END AS kind",
    "CASE l_suppkey % 4 WHEN 0 THEN 'ImageCaption' WHEN 1 THEN 'TableCaption' ELSE 'Caption' END AS caption_style",
    "CASE WHEN l_partkey % 6 = 0 THEN 'Figure' WHEN l_partkey % 6 = 1 THEN 'Tabela' ELSE NULL END AS seq_name",
    "CASE WHEN l_partkey % 5 = 0 THEN '' ELSE concat('Item ', CAST(l_partkey AS STRING), ' text') END AS text",
    "l_linestatus = 'F' AND l_partkey % 3 = 0 AS is_break",
    "l_partkey % 12 + 1 AS heading_n",
    "l_suppkey % 4 AS ilvl",
]
DOC_BLOCKS = f"SELECT l_orderkey AS doc_id, {_POS} AS pos, " + ", ".join(BLOCK_COLUMNS) + " FROM lineitem"


def doc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir, "l_returnflag", "l_linestatus").selectExpr("l_orderkey AS doc_id", "pos", *BLOCK_COLUMNS)


RUN_COLUMNS = [
    "CASE l_partkey % 5 WHEN 0 THEN 'ff0000' WHEN 1 THEN '#FF0000' WHEN 2 THEN 'auto' WHEN 3 THEN 'accent1' ELSE NULL END AS color",
    "CASE l_suppkey % 4 WHEN 0 THEN 'FFFF00' WHEN 1 THEN 'FFFFFF' ELSE NULL END AS fill",
    "CASE l_partkey % 3 WHEN 0 THEN 'yellow' WHEN 1 THEN 'none' ELSE NULL END AS highlight",
    "CAST(l_partkey % 4 * 8 AS STRING) AS sz",
    "l_partkey % 2 = 0 AS is_space",
]
STYLED_RUNS = f"SELECT l_orderkey AS doc_id, {_POS} AS pos, " + ", ".join(RUN_COLUMNS) + " FROM lineitem"
RAW_RUNS = "SELECT l_orderkey AS doc_id, " + ", ".join(RUN_COLUMNS) + " FROM lineitem"


def styled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).selectExpr("l_orderkey AS doc_id", "pos", *RUN_COLUMNS)


def raw_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styled runs without their position, for operators that do not depend on order."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", *RUN_COLUMNS)


COL_COLUMNS = [
    "CASE WHEN l_orderkey % 7 = 0 THEN 0 ELSE CAST(l_quantity * 100 AS INT) END AS w",
    "750 + l_orderkey % 9000 AS target_twips",
    "l_suppkey % 3 + 1 AS grid_span",
]
TABLE_COLS = f"SELECT l_orderkey AS table_id, {_POS} AS col, " + ", ".join(COL_COLUMNS) + " FROM lineitem"


def table_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).selectExpr("l_orderkey AS table_id", "pos AS col", *COL_COLUMNS)


TABLE_STYLE = """concat('width: ', CAST(p_size AS STRING), CASE p_partkey % 3 WHEN 0 THEN '%' WHEN 1 THEN 'px' ELSE 'pt' END,
 '; margin-left: ', CASE p_partkey % 4 WHEN 1 THEN '0' WHEN 2 THEN '24px' ELSE 'auto' END,
 '; margin-right: ', CASE WHEN p_partkey % 4 IN (0, 2) THEN 'auto' ELSE '0' END)"""
STYLED_TABLES = f"SELECT p_partkey AS table_id, p_partkey % 50 AS doc_id, {TABLE_STYLE} AS style FROM part"


def styled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS table_id", "p_partkey % 50 AS doc_id", f"{TABLE_STYLE} AS style")


MATH_SPANS = r"SELECT doc_id, unnest(regexp_extract_all(text, '\$([^$\n]+)\$', 1)) AS tex FROM documents"


def math_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\$([^$\n]+)\$"), F.lit(1))).alias("tex"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages dealt to all cores: the given tables are single files, and parsing costs more than the shuffle."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html").repartition(spark.sparkContext.defaultParallelism)


def parts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """part with its key and ``columns``, dealt to all cores as pages are: before bodies are made of it, as rows are short then."""
    return table(spark, sf_dir, "part").select("p_partkey", *columns).repartition(spark.sparkContext.defaultParallelism)


WORKER_COLUMNS = [
    "user_id % 7 AS worker_id",
    "CASE WHEN event_type = 'signup' THEN 'start' WHEN event_type = 'error' THEN 'check_failed' ELSE 'convert' END AS event",
    "event_type <> 'error' AS ok",
    "value * 100 AS duration_ms",
    "value * 3 AS queue_ms",
    "value / 6 AS cpu_percent",
    "value * 4 AS memory_mb",
    "event_id % 13 AS queue_size",
]
WORKER_LOG = "SELECT event_id, epoch_us(ts) AS ts_us, " + ", ".join(WORKER_COLUMNS) + " FROM events"


def worker_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "unix_micros(CAST(ts AS TIMESTAMP)) AS ts_us", *WORKER_COLUMNS)
