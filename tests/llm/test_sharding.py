import zlib

import pytest
from pyspark.sql import functions as F

from inkshard.llm.sharding import jump_shards, shard_documents, write_shards


def jump(key: int, n: int) -> int:
    """The published algorithm, in whole numbers."""
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 24, 1000])
def test_jump_hash(spark, n):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(-40, 300)]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", jump_shards(F.col("k"), n).alias("p")).collect()
    assert all((r.p.shard, r.p.grown) == (jump(r.k, n), jump(r.k, n + 1)) for r in got)
    assert all(r.p.grown in (r.p.shard, n) for r in got)


def check(rows, source, n):
    assert len(rows) == len(source)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "key" and r.shard == jump(-1 if r.doc_id is None else r.doc_id, n)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = lambda text: (len((text or "").encode()) + 8, zlib.crc32((text or "").encode()))
    assert sorted(map(str, ((r.doc_id, r["size"], r.text_crc32) for r in rows))) == sorted(map(str, ((s.doc_id, *sizes(s.text)) for s in source)))


def test_awkward_rows(awkward, nothing):
    check(shard_documents(awkward, 4).collect(), awkward.collect(), 4)
    assert shard_documents(nothing).collect() == []


def test_rendered_documents(documents, spark, tmp_path):
    check(shard_documents(documents).collect(), documents.collect(), 24)
    write_shards(documents, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == documents.count() and set(documents.columns) < set(back.columns)


def test_one_shard_spreads_over_tasks(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    out = shard_documents(df, 1).withColumn("task", F.spark_partition_id())
    assert out.select("task").distinct().count() > 1
    assert sorted(r.slot for r in out.collect()) == list(range(20_000))
