"""Tokens, references and rendering of awkward markup."""

import html
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from inkshard.operators.render import list_numbers, render_pages
from inkshard.sources.html import decode_entities, html_segments, html_tokens

CASES = [
    "<p>if a < b then x</p><p>next <i>c</i> d</p><p>tail</p>",
    '<a title="x>y" href=\'>\'>t</a>',
    "<SCRIPT>if (a < b) {}</SCRIPT><Style>p > a {}</STYLE>x",
    "a <b unclosed",
    '<p class="x>no end',
    "<!-- a > b --><!DOCTYPE html><?xml x?>1 <2 </ p>",
    "",
    "plain",
    "<br/><img src=x />&lt;&amp;",
]


def test_tokens_join_to_the_body_and_kinds(spark):
    df = spark.createDataFrame(list(enumerate(CASES)) + [(99, None)], "doc_id int, html string")
    rows = html_tokens(df).orderBy("doc_id", "pos").collect()
    for i, case in enumerate(CASES):
        assert "".join(r.tok for r in rows if r.doc_id == i) == case
    assert not [r for r in rows if r.doc_id == 99]
    kinds = lambda i: [(r.kind, r.tag) for r in rows if r.doc_id == i]
    assert kinds(0)[:4] == [("open", "p"), ("text", None), ("text", None), ("close", "p")]
    assert kinds(1) == [("open", "a"), ("text", None), ("close", "a")]
    assert kinds(2) == [("script", "script"), ("style", "style"), ("text", None)]
    assert {k for k, _ in kinds(3)} == {"text"}
    assert [k for k, _ in kinds(5)][:3] == ["comment", "doctype", "doctype"]


class Tags(HTMLParser):
    def __init__(self):
        super().__init__()
        self.seen = []

    def handle_starttag(self, tag, attrs):
        self.seen.append(tag)

    def handle_endtag(self, tag):
        self.seen.append("/" + tag)


def test_tags_agree_with_the_standard_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(F.col("page_id").alias("doc_id"), "html")
    toks = html_tokens(pages).filter("tag IS NOT NULL").orderBy("doc_id", "pos").collect()
    for page in pages.collect():
        parser = Tags()
        parser.feed(page.html)
        mine = []
        for r in (t for t in toks if t.doc_id == page.doc_id):
            mine += {"open": [r.tag], "close": ["/" + r.tag]}.get(r.kind, [r.tag, "/" + r.tag])
        assert mine == parser.seen


def test_references(spark):
    texts = ["&#x27;&copy;&hellip;&amp;lt;", "&#1234;&#x1F600;&#150;&#0;&#xD800;&#1114112;", "&unknown; & &; &amp &notit; a&b;", "&nbsp;|&#160;", "no reference", "&lt;b&gt;", None]
    got = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", decode_entities(F.col("t")).alias("t")).orderBy("i").collect()]
    assert got[0] == html.unescape(texts[0]) and got[5] == "<b>" and got[6] is None
    assert got[1] == "Ӓ😀–���"
    assert got[2:5] == ["&unknown; & &; &amp &notit; a&b;", " | ", "no reference"]


def rendered(spark, pages, dialect="plain"):
    df = spark.createDataFrame(list(enumerate(pages)), "doc_id int, html string")
    return {r.doc_id: (r.text, r.n_blocks) for r in render_pages(df, dialect).collect()}


@pytest.mark.parametrize("dialect", ["plain", "markdown", "textile", "html"])
def test_every_page_gives_one_row(spark, dialect):
    got = rendered(spark, ["", None, "<p></p>", "<ol></ol>", "<ol><li></li></ol>", "x"], dialect)
    assert [got[i] for i in range(5)] == [("", 0)] * 5 and got[5][1] == 1


def test_bare_less_than_keeps_text(spark):
    got = rendered(spark, [CASES[0], "<p>1 &#60; 2 and &#x3c;b&#62;</p>", "<ul><li>a<li><p>b</p></ul>"])
    assert got[0] == ("if a < b then x\n\nnext c d\n\ntail", 3)
    assert got[1] == ("1 < 2 and <b>", 1)
    assert got[2] == ("-   a\n-   b", 2)


def test_numbers_of_nested_lists(spark):
    page = "<ol><li>a<ul><li>x</li></ul></li><li>b<ol><li>y</li><li>z</li></ol></li><li>c</li></ol><li>loose</li>"
    assert rendered(spark, [page])[0][0] == "1.  a\n-   x\n2.  b\n1.  y\n2.  z\n3.  c\n\nloose"


def test_row_form_numbers_the_same(spark):
    rng = random.Random(5)
    pages = ["".join(rng.choice(["<ol>", "</ol>", "<ul>", "</ul>", f"<li>{i}", "<p>p</p>"]) for i in range(30)) for _ in range(6)]
    df = spark.createDataFrame(list(enumerate("<ol>" + p for p in pages)), "doc_id int, html string")
    from inkshard.operators.render import page_blocks

    whole = page_blocks(df).select("doc_id", F.explode("blocks").alias("b")).select("doc_id", "b.*")
    for chunk in (3, 1 << 30):
        rows = list_numbers(html_segments(df), chunk=chunk).select("doc_id", "kind", "level", "number", "text")
        assert sorted(map(str, rows.collect())) == sorted(map(str, whole.collect()))
