"""Reading documents in and writing rendered documents out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkshard.functions import constants as K
from inkshard.functions.text import col
from inkshard.sources.dims import mime_type, output_name
from inkshard.sources.trees import read_tree


def read_corpus(spark: SparkSession, path: str, source_format: str, nested: bool = False, where: Column | None = None) -> DataFrame:
    """``(doc_id, body)``: text for text formats, bytes for everything else; one row per file, none for files without bytes.

    ``nested`` takes all files at any depth below the folder ``path``, whose own folders are listed by tasks, and files are read
    by the tasks that find them (``read_tree``); where that does not hold, and without ``nested``, the driver holds an entry for
    each file.  A pattern is expanded on the driver, one folder after the other.  Folders and files whose names start with ``_`` or ``.``
    are hidden.  ``where``, a condition on ``path``, chooses files before they are opened.
    """
    text = source_format in K.TEXT_SOURCES
    files = read_tree(spark, path, text, where) if nested else None
    if files is not None:
        files = files.withColumn("body", F.col("body").cast("string")) if text else files
    else:
        reader = spark.read.option("recursiveFileLookup", str(nested).lower())
        if text:
            files = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
        else:
            files = reader.format("binaryFile").load(path).select("path", F.col("content").alias("body"))
        files = files if where is None else files.filter(where)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", F.lit(source_format).alias("source_format"), "body")


def read_pages(spark: SparkSession, path: str, id_column: str = "page_id", body_column: str = "html") -> DataFrame:
    """``(doc_id, html)`` from a parquet table of pages."""
    return spark.read.parquet(path).select(F.col(id_column).alias("doc_id"), F.col(body_column).alias("html"))


def decode_body(body: Column | str, encoding: str | None = None, lenient: bool = False) -> Column:
    """Text of a binary body.

    With an ``encoding`` bad bytes fail the query; ``lenient`` replaces them (UTF-8);
    with neither, bodies that are not valid UTF-8 give null and so pass through untouched.
    """
    b = col(body)
    if encoding:
        return F.decode(b, encoding)
    text = b.cast("string")
    return F.make_valid_utf8(text) if lenient else F.when(F.is_valid_utf8(text), text)


def rendered_files(df: DataFrame, target: str = "target_format") -> DataFrame:
    """Add the name and MIME type each rendered document is delivered with."""
    return df.withColumns({"file_name": output_name(target), "mime_type": mime_type(target)})


def write_rendered(df: DataFrame, path: str, fmt: str = "parquet", target: str = "target_format") -> None:
    """Write rendered documents, one folder per target format."""
    rendered_files(df, target).write.mode("overwrite").partitionBy(target).format(fmt).save(path)
