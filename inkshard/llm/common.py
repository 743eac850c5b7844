"""What several operators of this folder share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkshard.session import saved

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = " \t\n\x0b\f\r"
#: The same in bytes, for code that runs inside tasks.
ASCII_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is; pure ASCII takes the quick built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def text_key(text: Column) -> Column:
    """64 bits that tell apart rows which repeat a doc_id with another text."""
    return F.xxhash64(F.lit("text"), F.coalesce(text, F.lit("")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` bears it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns of these names under others, and how to name them back: for steps that add such columns."""
    own = [c for c in df.columns if c.lower() in names]
    hidden = dict(zip(own, fresh(df, *own), strict=True))
    return df.withColumnsRenamed(hidden), {h: c for c, h in hidden.items()}


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Rows of an Arrow batch: whole texts lie in it, on the JVM's side and on Python's.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches lowered to ``BATCH_ROWS`` rows if they are larger; called by every operator that hands texts to Python."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def give_back() -> None:
    """Return a worker's free memory to the machine at the end of a task: workers live on, and the next step's need theirs."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def larger(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` and a little more: for narrow rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows range-sorted by keys and order, with ``_part`` (their range) and ``_at`` (place in it), saved.

    A key with many rows spreads over as many ranges as its rows need.
    """
    by = [*keys, *order]
    ranged = df.repartitionByRange(shuffle_parts(df), *by).sortWithinPartitions(*by)
    return saved(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2 ... among the rows of equal ``keys`` (not null), in the given order, without gaps.

    No task ever holds a key: rows are range-sorted, each range counts its rows of a key,
    and the counts of earlier ranges are added.  Those counts are one row for each range
    and each border of two keys; for a few thousand keys at most they are small enough to
    be broadcast, which this function does.
    """
    rows = dealt(df, keys, order)
    counts = rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*keys, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_base"))
    return rows.join(F.broadcast(base), [*keys, "_part"]).withColumn(name, F.col("_at") + F.col("_base")).drop("_part", "_at", "_base")
