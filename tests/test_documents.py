"""Rendering goldens, trees, packages and streams."""

import io
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

from inkshard.operators import joins as J
from inkshard.operators import nodes as N
from inkshard.operators import structure as S
from inkshard.operators.render import render_blocks, render_pages
from inkshard.sources import docx as D
from inkshard.sources.ast_json import read_ast_json, write_ast_json
from inkshard.sources.corpus import read_corpus, write_rendered
from inkshard.sources.html import html_nodes, html_tokens, register_html_nodes

PAGE = """<html><body>
<h1>Simple html with an ordered list</h1>
<ol>
  <li>First</li>
  <li>Second</li>
  <li>Third</li>
</ol>
<p>Some <b>bold German vowels ä, ö, and ü</b> at the bottom.</p>
</body></html>"""
TITLE, TAIL = "Simple html with an ordered list", "bold German vowels ä, ö, and ü"
GOLDEN = {
    "plain": f"{TITLE}\n\n1.  First\n2.  Second\n3.  Third\n\nSome {TAIL} at the bottom.",
    "markdown": f"# {TITLE}\n\n1.  First\n2.  Second\n3.  Third\n\nSome **{TAIL}** at the bottom.",
    "textile": f"h1(#simple-html-with-an-ordered-list). {TITLE}\n\n# First\n# Second\n# Third\n\nSome *{TAIL}* at the bottom.",
}


def docs(spark, *pages):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "doc_id bigint, html string")
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    rows.write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


@pytest.mark.parametrize("dialect", GOLDEN)
def test_goldens(spark, dialect):
    assert render_pages(docs(spark, PAGE), dialect).first().text == GOLDEN[dialect]


def test_loose_lists(spark):
    blocks = spark.createDataFrame([(1, i, "ordered", None, i, t) for i, t in enumerate(["First", "Second"], 1)], "doc_id int, pos int, kind string, level int, number int, text string")
    assert render_blocks(blocks, "plain", loose_lists=True).first().text == "1.  First\n\n2.  Second"


def test_both_ways_of_rendering_agree(spark):
    """A page without ordered lists renders the same with string functions and with block rows."""
    page = "x<h2>A &#38; &#246;&lt;</h2><ul><li><p>q</p><li>r <b>t</b></ul><div>z</div> tail<br>u<p><b>open<p> </p><h7>k</h7>"
    for dialect in ("plain", "markdown", "html"):
        quick = render_pages(docs(spark, page), dialect).first()
        slow = render_pages(docs(spark, page + "<!-- <ol -->"), dialect).first()
        assert (quick.text, quick.n_blocks) == (slow.text, slow.n_blocks)


def test_nested_numbers(spark):
    page = "<ol><li>a<ul><li>x<li>y</ul></li><li>b<ol><li>p</ol></li><li>c</li></ol><ol><li>d</ol>"
    assert render_pages(docs(spark, page), "plain").first().text == "1.  a\n-   x\n-   y\n2.  b\n1.  p\n3.  c\n1.  d"


def test_huge_document_parts(spark):
    blocks = spark.createDataFrame([(1, i, "para", None, None, f"p{i}") for i in range(30)], "doc_id int, pos int, kind string, level int, number int, text string")
    parts = render_blocks(blocks, "plain", part=7).orderBy("part").collect()
    assert len(parts) > 2
    assert "".join(p.text for p in parts) == "\n\n".join(f"p{i}" for i in range(30))


def test_tokens_and_tree(spark):
    page = "<p>a<br>b<script>if (a<b) </p></script><!-- <p> --><p>c"
    assert [r.kind for r in html_tokens(docs(spark, page)).orderBy("pos").collect()] == ["open", "text", "open", "text", "script", "comment", "open", "text"]
    nodes = html_nodes(docs(spark, "<ul><li>a<li>b<p>c</ul>", None))
    got = [(r.tag, r.depth, r.parent_pos, r.text) for r in nodes.orderBy("doc_id", "pos").collect()]
    assert got == [("ul", 1, None, ""), ("li", 2, 0, "a"), ("li", 2, 0, "b"), ("p", 3, 3, "c")]
    register_html_nodes(spark)
    docs(spark, "<p>x</p>").createOrReplaceTempView("docs_for_lateral")
    assert spark.sql("SELECT tag FROM docs_for_lateral, LATERAL html_nodes(html)").first().tag == "p"


@pytest.mark.parametrize(
    "page, wrapped",
    [("<ol><ol><li>a</ol></ol>", 1), ("<ol><ul><li>a</ul></ol>", 1), ("<ul><ol><li>a</ol></ul>", 1), ("<ol><li><ol><li>a</ol></ol>", 0)],
)
def test_orphan_lists(spark, page, wrapped):
    assert N.orphan_lists(html_nodes(docs(spark, page))).count() == wrapped


def test_containment_over_bins(spark):
    outer = spark.createDataFrame([(1, 0, 500), (1, 10, 20), (2, 5, 9)], "doc_id int, pos int, close_pos int")
    inner = spark.createDataFrame([(1, 15), (1, 300), (1, 500), (2, 5), (2, 6)], "doc_id int, pos int")
    pairs = {(r.doc_id, r.pos, r.outer_pos) for r in N.contained_in(inner, outer).collect()}
    assert pairs == {(1, 15, 0), (1, 15, 10), (1, 300, 0), (2, 6, 5)}
    assert {(r.doc_id, r.pos) for r in N.inside_any(inner, outer, negate=True).collect()} == {(1, 500), (2, 5)}


def test_caption_adjacency(spark):
    seqs = {1: ["caption", "table"], 2: ["table", "caption"], 3: ["caption", "bookmark", "empty", "table"], 4: ["caption", "para", "table"]}
    rows = [(d, i, "para" if k == "empty" else k, "" if k == "empty" else "t") for d, ks in seqs.items() for i, k in enumerate(ks)]
    got = S.caption_table_adjacency(spark.createDataFrame(rows, "doc_id int, pos int, kind string, text string"))
    assert {r.doc_id: r.before_table for r in got.collect()} == {1: True, 2: False, 3: True, 4: False}


def test_augment_styles_twice(spark):
    needed = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b")], "doc_id int, style_id string")
    existing = spark.createDataFrame([(1, "a")], "doc_id int, style_id string")
    once = J.augment_styles(existing, needed)
    assert once.count() == 2 and J.augment_styles(once, needed).count() == 2


def test_augment_styles_in_one_grouping(spark):
    needed = spark.createDataFrame([(1, "a", "x"), (1, "b", None), (2, "a", "y"), (2, "a", "y"), (None, "c", "z")], "doc_id int, style_id string, fg string")
    existing = spark.createDataFrame([(1, "a", 7), (3, "d", 8), (3, "d", 9)], "doc_id int, style_id string, old int")
    out = J.augment_styles(existing, needed)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.columns == ["doc_id", "style_id", "old", "fg"]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(
        map(str, [(1, "a", 7, None), (3, "d", 8, None), (3, "d", 9, None), (1, "b", None, None), (2, "a", None, "y"), (None, "c", None, "z")])
    )
    again = J.augment_styles(out, needed)
    assert again.count() == out.count()


def test_json_round_trip(spark):
    blocks = spark.createDataFrame([(1, 0, "header", 1, 'a "b"'), (1, 1, "para", None, "ü")], "doc_id int, pos int, kind string, level int, text string")
    back = read_ast_json(write_ast_json(blocks)).orderBy("pos").collect()
    assert [(r.kind, r.level, r.text) for r in back] == [("header", 1, 'a "b"'), ("para", None, "ü")]


def test_files_in_and_out(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    with open(f"{folder}/a.html", "w") as f:
        f.write("<p>one\ntwo</p>")
    corpus = read_corpus(spark, folder, "html")
    assert corpus.first().body == "<p>one\ntwo</p>"
    assert bytes(read_corpus(spark, folder, "docx").first().body) == b"<p>one\ntwo</p>"
    out = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    write_rendered(render_pages(corpus.select("doc_id", F.col("body").alias("html"))).withColumn("target_format", F.lit("plain")), out + "/r")
    assert spark.read.parquet(out + "/r").first().file_name == "converted-document.txt"


def package(**parts):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, xml in parts.items():
            z.writestr(f"word/{name}.xml", xml)
    return bytearray(buf.getvalue())


def test_packages(spark):
    w = 'xmlns:w="urn:w"'
    good = package(document=f'<w:document {w}><w:p><w:r><w:rPr><w:color w:val="ff0000"/></w:rPr><w:t>a</w:t><w:t>b</w:t></w:r></w:p></w:document>', styles=f"<w:styles {w}/>", theme="<x/>")
    bomb = package(document='<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>', footer2="<broken")
    df = spark.createDataFrame([(1, good), (2, bomb), (3, bytearray(b"not a zip"))], "doc_id bigint, content binary")
    parts = D.docx_parts(df)
    assert {(r.doc_id, r.part) for r in parts.collect()} == {(1, "word/document.xml"), (1, "word/styles.xml"), (2, "word/document.xml"), (2, "word/footer2.xml")}
    runs = D.docx_runs(D.docx_nodes(parts)).collect()
    assert [(r.doc_id, r.text, r.color) for r in runs] == [(1, "ab", "ff0000")]
