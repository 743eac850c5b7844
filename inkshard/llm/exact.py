"""Exact copies among rendered documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkshard.llm.common import ascii_lower, saved


def content_hash(text: Column) -> Column:
    """128 bits of a text, as 16 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_copies(documents: DataFrame, digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row for each row of documents ``(doc_id, text)``.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the
    largest doc_id stays (``kept``, its id is ``keep_id``).  ``text_sha256`` is that of the
    lower-cased text.  Null counts as empty; a null doc_id is smaller than any other; of rows that
    repeat both the text and the largest doc_id every one is ``kept``, as they are the
    same row twice.  Other columns are ignored.

    Texts are grouped by a 128-bit hash with map-side combine, so a text that a third of all rows
    share shrinks to a row for each task.  The bytes inside a group are compared on the way: its
    least and its greatest text are the same only if all are.  Groups where they differ (a collision of
    ``digest``) are grouped again by their whole text.
    """
    norm = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm")).withColumn("hash", digest(F.col("norm")))
    sha256 = lambda text: F.sha2(text.cast("binary"), 256).alias("text_sha256")
    ids = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    groups = texts.groupBy("hash").agg(*ids, F.min("norm").alias("least"), F.max("norm").alias("most"))
    groups = saved(groups.select("hash", "keep_id", "group_size", (F.col("least") == F.col("most")).alias("equal"), sha256(F.col("least"))))

    out = texts.select("doc_id", "hash").join(groups.filter("equal").drop("equal"), "hash")
    collided = groups.filter("NOT equal").select("hash")
    if not collided.isEmpty():
        rows = texts.join(collided, "hash", "left_semi")
        by_text = rows.groupBy("hash", "norm").agg(*ids).select("hash", "keep_id", "group_size", sha256(F.col("norm")))
        again = rows.select("doc_id", "hash", sha256(F.col("norm"))).join(by_text, ["hash", "text_sha256"])
        out = out.unionByName(again)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
