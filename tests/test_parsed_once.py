"""Bodies made of part are parsed in all cores, and once, however often the nodes are read; so are blocks numbered."""

import pytest

from inkshard.operators import nodes as N
from inkshard.plans import PLANS
from inkshard.plans import markup, packages
from inkshard.sources.html import html_nodes

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("made", [markup._docs, packages._parts])
def test_bodies_are_dealt_to_all_cores(spark, made):
    assert made(spark, SF).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1


@pytest.mark.parametrize("name", ["f15_css_cascade", "f10_inline_svg_to_img", "p12_formatted_paragraphs", "p13_sizeable_images", "p16_markup_passthrough", "s5_docx_parts"])
def test_queries_deal_part(spark, name):
    assert "Repartition" in plan_of(PLANS[name].build(spark, SF))


@pytest.fixture
def nodes(spark):
    bodies = ["<ol><ol><li>a</li></ol><ul><ul></ul></ul></ol>", "<ul><li>z<ol></ol></li></ul>", None, ""]
    return html_nodes(spark.createDataFrame(list(enumerate(bodies)), "doc_id long, html string"))


def test_orphan_lists(nodes):
    out = N.orphan_lists(nodes)
    assert "MapInArrow" not in plan_of(out)
    assert sorted((r.doc_id, r.tag, r.parent_tag) for r in out.collect()) == [(0, "ol", "ol"), (0, "ul", "ol"), (0, "ul", "ul")]


def test_wrap_orphan_lists(nodes):
    out = N.wrap_orphan_lists(nodes)
    assert "MapInArrow" not in plan_of(out)
    assert out.filter("marker_suppressed").count() == 3 and out.count() == nodes.count() + 3


def test_rewrite_by_a_table_function(nodes):
    out = N.rewrite(nodes, (nodes["tag"] == "li", lambda rows: rows.filter("false")), (nodes["tag"] == "ol", lambda rows: rows.unionByName(rows)))
    assert "MapInArrow" not in plan_of(out)
    assert sorted(r.tag for r in out.collect()) == ["ol"] * 6 + ["ul"] * 3


@pytest.mark.parametrize("name", ["p11_is_caption", "p11_is_caption_of_pages"])
def test_is_caption(spark, name):
    assert "MapInArrow" not in plan_of(PLANS[name].build(spark, SF))


@pytest.mark.parametrize("name", ["o2_splice_order", "u2_splice_blocks", "j10_fill_listings", "w14_decoration_segments"])
def test_blocks_are_numbered_once(spark, name):
    files = PLANS[name].build(spark, SF).inputFiles()
    assert files and not [f for f in files if "lineitem" in f]
