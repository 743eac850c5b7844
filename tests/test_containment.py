"""Structural merges of intervals and rows, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from inkshard.operators.nodes import contained_in, inside_any
from inkshard.plans.views import pages
from inkshard.sources.html import html_nodes

INNER, OUTER = "doc_id int, pos int, name string", "doc_id int, pos int, close_pos int, name string"


def forest(rng, start, end, depth):
    """Intervals inside or beside each other, some of them repeated or sharing an end."""
    at = start
    while depth and at < end:
        close = rng.randint(at, end)
        yield at, close
        if rng.random() < 0.3:
            yield at, close
        yield from forest(rng, at + rng.randint(0, 1), close - rng.randint(0, 1), depth - 1)
        at = close + rng.randint(0, 4)


def around(inner, outer):
    return sorted((d, p, n, a, b, m) for d, p, n in inner for e, a, b, m in outer if d == e and a < p < b)


@pytest.mark.parametrize("chunk", [7, 64, 65_536])
def test_all_pairs(spark, chunk):
    rng = random.Random(5)
    outer = [(d, a, b, rng.choice("xy")) for d in range(6) for a, b in forest(rng, 0, 150, 5)]
    inner = [(d, rng.randint(-2, 160), rng.choice("uvw")) for d in range(8) for _ in range(60)]
    i, o = spark.createDataFrame(inner, INNER), spark.createDataFrame(outer, OUTER)
    want = around(inner, outer)
    got = contained_in(i, o, ["name"], chunk=chunk)
    assert got.columns == ["doc_id", "pos", "name", "outer_pos", "outer_close", "outer_name"]
    assert sorted(map(tuple, got.collect())) == want and len(want) > 500
    within = {w[:3] for w in want}
    for negate in (False, True):
        kept = sorted(map(tuple, inside_any(i, o, negate, chunk=chunk).collect()))
        assert kept == sorted(r for r in inner if (r in within) != negate)


def test_crossing_intervals(spark):
    o = spark.createDataFrame([(1, 0, 5, "a"), (1, 3, 9, "b")], OUTER)
    row = lambda pos: spark.createDataFrame([(1, pos, "r")], INNER)
    assert {r.outer_name for r in contained_in(row(4), o, ["name"]).collect()} == {"a", "b"}
    assert inside_any(row(7), o).count() == 1 and inside_any(row(9), o).count() == 0
    with pytest.raises(Exception, match="cross"):
        contained_in(row(7), o, ["name"]).collect()


def test_nulls_and_nothing(spark):
    inner = spark.createDataFrame([(None, 5, "a"), (1, None, "b"), (1, 5, None)], INNER)
    outer = spark.createDataFrame([(None, 0, 9, "x"), (1, None, 9, "y"), (1, 0, None, "z"), (1, 8, 2, "w"), (1, 0, 9, None)], OUTER)
    assert [tuple(r) for r in contained_in(inner, outer, ["name"]).collect()] == [(1, 5, None, 0, 9, None)]
    assert {r.name for r in inside_any(inner, outer, negate=True).collect()} == {"a", "b"} and inside_any(inner, outer).count() == 1
    none = outer.filter("false")
    assert contained_in(inner, none).collect() == [] and inside_any(inner, none, negate=True).count() == 3
    assert contained_in(inner.filter("false"), outer).collect() == []


def test_ancestors_of_real_nodes(spark):
    """Every node of pages meets its ancestors: depth less one of them, the parent innermost."""
    nodes = html_nodes(pages(spark, "/root/testdata/sf0.001")).cache()
    pairs = contained_in(nodes.select("doc_id", "pos", "depth", "parent_pos"), nodes.select("doc_id", "pos", "close_pos"))
    found = pairs.groupBy("doc_id", "pos").agg(F.count(F.lit(1)).alias("n"), F.max("outer_pos").alias("inner_most"), F.first("depth").alias("depth"), F.first("parent_pos").alias("parent_pos"))
    assert found.filter("n <> depth - 1 OR inner_most <> parent_pos").count() == 0
    assert found.count() == nodes.filter("depth > 1").count() > 0


def test_wide_intervals_cost_no_more(spark):
    """A huge document in few intervals: rows handled are those of the input and the pairs, in several tasks, and nothing is listed by place."""
    n = 400_000
    inner = spark.range(n).select((F.col("id") % 1 + 1).alias("doc_id"), (F.col("id") + 1).cast("int").alias("pos"))
    outer = spark.createDataFrame([(1, 0, n + 10, "all"), (1, 10, 20, "few")], OUTER)
    pairs = contained_in(inner, outer, ["name"])
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert {r["name"]: r["count"] for r in pairs.groupBy("name").count().collect()} == {"all": n, "few": 9}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert pairs.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
