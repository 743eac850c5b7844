"""Rewrites up and down the trees of real pages, against recursion."""

import pytest
from pyspark.sql import functions as F

from inkshard.operators.nodes import rewrite_down, rewrite_up
from inkshard.plans.views import pages
from inkshard.sources.html import html_nodes


@pytest.fixture(scope="module")
def nodes(spark):
    some = pages(spark, "/root/testdata/sf0.001").filter("doc_id < 12")
    deep = spark.createDataFrame([(100, "<div>" * 15 + "x" + "</div>" * 15), (101, "<p>a"), (102, "")], "doc_id long, html string")
    return html_nodes(some.unionByName(deep)).select("doc_id", "pos", "parent_pos", "depth", "tag", "text").cache()


def tree(nodes):
    rows = {(r.doc_id, r.pos): r for r in nodes.collect()}
    children = {}
    for key, r in rows.items():
        children.setdefault((r.doc_id, r.parent_pos), []).append(key)
    return rows, children


def test_up(nodes):
    """Not a sum over the subtree: each value depends on the rewritten ones below."""
    rows, children = tree(nodes)
    out = rewrite_up(nodes, {"below": F.max("weight"), "n": F.count(F.lit(1))}, {"weight": (F.coalesce("below", F.lit(0)) * 2 + F.coalesce("n", F.lit(0)) + F.length("tag")) % 1_000_003, "tag": F.upper("tag")})
    weight = lambda key: (max((weight(c) for c in children.get(key, [])), default=0) * 2 + len(children.get(key, [])) + len(rows[key].tag)) % 1_000_003
    got = {(r.doc_id, r.pos): (r.weight, r.tag, r.text) for r in out.collect()}
    assert got == {key: (weight(key), r.tag.upper(), r.text) for key, r in rows.items()} and len(got) == len(rows)


def test_down(nodes):
    rows, _ = tree(nodes)
    start = nodes.withColumn("path", F.lit(None).cast("string"))
    out = rewrite_down(start, {"above": F.col("path")}, {"path": F.concat_ws(">", "above", "tag")})
    path = lambda r: f"{path(rows[r.doc_id, r.parent_pos])}>{r.tag}" if (r.doc_id, r.parent_pos) in rows else r.tag
    assert {(r.doc_id, r.pos): r.path for r in out.collect()} == {key: path(r) for key, r in rows.items()}


def test_nothing(nodes):
    none = nodes.filter("false").withColumn("v", F.lit(1))
    assert rewrite_up(none, {"s": F.sum("v")}, {"v": F.col("s")}).collect() == [] and rewrite_down(none, {"s": F.col("v")}, {"v": F.col("s")}).collect() == []
