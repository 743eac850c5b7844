"""Rendered documents dealt to output shards by jump consistent hashing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkshard.llm.common import numbered

# The multiplier of the published hash, and its quarters.
MULTIPLIER = 2862933555777941757
_HIGH, _LOW1, _LOW0 = MULTIPLIER >> 32, MULTIPLIER >> 16 & 0xFFFF, MULTIPLIER & 0xFFFF


def _low_bits(value: Column, n: int) -> Column:
    return value.bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def _step(state: Column, shards: int) -> Column:
    """One jump.  ``state``: hi, lo (the 64-bit generator in halves), at (the next jump), shard, grown.

    Products are built from 16-bit parts, so that nothing overflows in ANSI mode.
    """
    hi, lo, at = state["hi"], state["lo"], state["at"]
    b = lo * F.lit(_LOW1)
    low = lo * F.lit(_LOW0) + F.shiftleft(_low_bits(b, 16), 16) + F.lit(1)
    high = F.shiftright(low, 32) + F.shiftright(b, 16) + lo * F.lit(_HIGH) + hi * F.lit(_LOW0) + F.shiftleft(_low_bits(hi * F.lit(_LOW1), 16), 16)
    high = _low_bits(high, 32)
    jump = ((at + F.lit(1)).cast("double") * (F.lit(2147483648.0) / (F.shiftright(high, 1) + F.lit(1)).cast("double"))).cast("long")
    moved = F.struct(
        high.alias("hi"),
        _low_bits(low, 32).alias("lo"),
        jump.alias("at"),
        F.when(at < shards, at).otherwise(state["shard"]).alias("shard"),
        at.alias("grown"),
    )
    return F.when(at <= shards, moved).otherwise(state)


def jump_shards(key: Column, shards: int) -> Column:
    """``struct(shard, grown)``: the shard of a 64-bit key among ``shards`` shards, and among one more.

    A key needs about ln(shards) jumps.  A fixed number above that is made for every row;
    the rare key that is not through then goes on for as many as there can be.
    """
    zero = F.lit(0).cast("long")
    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), _low_bits(key, 32).alias("lo"), zero.alias("at"), zero.alias("shard"), zero.alias("grown"))
    usual = min(shards + 1, 2 * math.ceil(math.log(shards + 1)) + 8)
    run = lambda state, steps: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, lambda s, _: _step(s, shards))
    state = run(start, usual)
    if usual <= shards:
        state = F.when(state["at"] <= shards, run(state, shards + 1)).otherwise(state)
    return F.struct(state["shard"].cast("int").alias("shard"), state["grown"].cast("int").alias("grown"))


def shard_documents(documents: DataFrame, shards: int = 24) -> DataFrame:
    """The shard manifest of rendered documents ``(doc_id, text)``, one row for each row.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.  ``shard`` depends on
    doc_id and the number of shards alone (law ``key``): no ring table, no counting, and with one
    more shard (``grown_shard``) a row stays or moves into the new one.  ``slot`` is the row's
    place in its shard, by doc_id, gapless from 0.  ``size`` is the text's UTF-8 bytes plus 8.

    Only ids, sizes and checksums are shuffled, once, range-sorted by (shard, doc_id): a
    shard spans many tasks.  A null text counts as empty (size 8, checksum 0), a null doc_id as -1
    for the choice of the shard only.  Repeated rows each get a slot.  Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    place = jump_shards(F.coalesce(F.col("doc_id"), F.lit(-1)).cast("long"), shards)
    rows = documents.select(
        F.col("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        place.alias("_place"),
    ).select("doc_id", "size", "text_crc32", F.col("_place.shard").alias("shard"), F.col("_place.grown").alias("grown_shard"))
    out = numbered(rows, ["shard"], ["doc_id", "text_crc32"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(documents: DataFrame, path: str, shards: int = 24) -> None:
    """Write the documents, all columns, one folder for each shard (``shard=0`` ...).

    A column called shard gives way to the number of the shard.  Null doc_ids share a shard, repeated rows are written as often as they stand
    there, and an empty table writes no shard.
    """
    place = jump_shards(F.coalesce(F.col("doc_id"), F.lit(-1)).cast("long"), shards)
    documents.withColumn("shard", place["shard"]).write.mode("overwrite").partitionBy("shard").parquet(path)
