"""Lines that many rendered documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkshard.llm.common import SPACE, ascii_lower, fresh, saved, shuffle_parts, text_key


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _dropped_lines(documents: DataFrame, min_chars: int, min_documents: int) -> DataFrame:
    """``(doc_id, text_key, dropped)``: sorted positions of lines to drop, for documents that have any."""
    lines = documents.filter(F.col("doc_id").isNotNull()).select("doc_id", text_key(F.col("text")).alias("text_key"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    # The cheap length test first: stripping never makes a line longer.
    key = ascii_lower(F.btrim("line", F.lit(SPACE)))
    lines = lines.filter(F.char_length("line") >= min_chars).withColumn("key", key).filter(F.char_length("key") >= min_chars)
    # Saved, as the range sort samples its input first and two branches read it.
    hashed = saved(lines.select("doc_id", "text_key", "pos", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2")))
    # Range-partitioned by hash, secondary sort by document and position.  The ranges cut
    # through a hash that many documents share.
    ranged = hashed.repartitionByRange(shuffle_parts(documents), "h1", "h2", F.col("doc_id").desc()).sortWithinPartitions("h1", "h2", F.col("doc_id").desc(), "pos")
    # A document's first occurrence in its range; a document's rows of a hash lie in one range.
    firsts = ranged.groupBy("h1", "h2", "doc_id").agg(F.min("pos").alias("pos"))
    shared = firsts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_n"), F.max("doc_id").alias("_keeper")).filter(F.col("_n") >= min_documents)
    drops = ranged.join(shared, ["h1", "h2"]).filter("doc_id <> _keeper")
    return drops.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def kept_runs(n_lines: Column, dropped: Column) -> Column:
    """The keep bitmap, compressed: runs ``(start, length)`` of lines that stay."""
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda p: p + 1))
    ends = F.concat(dropped, F.array(n_lines))
    runs = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def line_bitmaps(documents: DataFrame, min_chars: int = 40, min_documents: int = 5) -> DataFrame:
    """``documents`` with ``n_lines``, ``n_dropped`` and ``keep``, the compressed bitmap of lines that stay.

    A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased.  Keys
    of ``min_chars`` code points and more that ``min_documents`` doc_ids hold lose all their
    lines except in the largest doc_id that holds them.  ``keep`` lists the runs
    ``(start, length)`` of lines that stay; ``apply_keep`` makes the text of it.

    Null and empty texts are one empty line.  Rows that repeat a doc_id count as one document, each
    with its own lines; rows with a null doc_id stay whole and do not count.  Columns that
    bear the names of new ones are replaced.

    Lines are compared by 128-bit hashes; the shuffles carry hashes and positions, and the text once,
    to meet its dropped positions.
    """
    drops = _dropped_lines(documents.select("doc_id", "text"), min_chars, min_documents)
    key, doc, dropped = fresh(documents, "_text_key", "_doc", "_dropped")
    drops = drops.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key + "_"), F.col("dropped").alias(dropped))
    rows = documents.withColumn(key, text_key(F.col("text")))
    rows = rows.join(drops, (F.col("doc_id") == F.col(doc)) & (F.col(key) == F.col(key + "_")), "left")
    gone = F.coalesce(F.col(dropped), F.array().cast("array<int>"))
    n_lines = F.size(split_lines(F.col("text")))
    return rows.withColumns({"n_lines": n_lines.cast("long"), "n_dropped": F.size(gone).cast("long"), "keep": kept_runs(n_lines, gone)}).drop(doc, key, key + "_", dropped)


def apply_keep(text: Column, keep: Column) -> Column:
    """The lines that stay, joined by line feeds."""
    lines = split_lines(text)
    return F.array_join(F.flatten(F.transform(keep, lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")
