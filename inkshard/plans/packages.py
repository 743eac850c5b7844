"""Queries over office packages whose parts are built from part."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from inkshard.operators import joins as J
from inkshard.plans.registry import plan
from inkshard.plans.views import parts
from inkshard.sources import docx as D

_XML = """concat('<w:document xmlns:w="urn:w"><w:body>',
 '<w:p><w:pPr><w:pStyle w:val="Caption"/><w:jc w:val="', CASE WHEN p_partkey % 2 = 0 THEN 'center' ELSE 'both' END, '"/><w:ind w:left="', p_size, '"/></w:pPr>',
 '<w:r><w:rPr><w:color w:val="', CASE WHEN p_partkey % 3 = 0 THEN 'auto' ELSE 'ff0000' END, '"/><w:sz w:val="', p_size, '"/></w:rPr><w:t>', p_name, '</w:t></w:r>',
 CASE WHEN p_partkey % 5 = 0 THEN '<w:r><w:instrText> SEQ Table </w:instrText></w:r>' ELSE '' END, '</w:p>',
 '<w:tbl><w:tblPr><w:tblW w:w="', p_size * 100, '" w:type="dxa"/><w:jc w:val="end"/></w:tblPr><w:tblGrid><w:gridCol w:w="5"/><w:gridCol/></w:tblGrid>',
 '<w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/><w:shd w:fill="', CASE WHEN p_partkey % 4 = 0 THEN 'FFFFFF' ELSE '00ff00' END, '"/></w:tcPr><w:p><w:pPr><w:numPr>',
 CASE p_partkey % 3 WHEN 0 THEN '<w:ilvl w:val="2"/>' WHEN 1 THEN '<w:ilvl w:val="x"/>' ELSE '' END, '</w:numPr></w:pPr><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>',
 '<w:sectPr><w:headerReference w:id="h1"/><w:pgSz w:w="', p_size + 100, '" w:h="200"/><w:titlePg/></w:sectPr></w:body></w:document>')"""


@F.pandas_udf(BinaryType())
def _zipped(xml: pd.Series, broken: pd.Series) -> pd.Series:
    """Test packages: a body part, a part to ignore, or bytes that are no package."""
    def one(text: str, bad: bool) -> bytes:
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            z.writestr("word/document.xml", text)
            z.writestr("word/header1.xml", "<!DOCTYPE x><x/>")
            z.writestr("word/settings.xml", "<x/>")
        return b"no zip" if bad else buf.getvalue()

    return pd.Series([one(t, b) for t, b in zip(xml, broken)])


def _parts(spark, sf):
    return parts(spark, sf, "p_size", "p_name").select(F.col("p_partkey").alias("doc_id"), F.lit("word/document.xml").alias("part"), F.encode(F.expr(_XML), "UTF-8").alias("xml"))


def _nodes(spark, sf):
    return D.docx_nodes(_parts(spark, sf)).drop("part").withColumn("part", F.lit("word/document.xml"))


@plan("s5_docx_parts", "SELECT p_partkey AS doc_id, part FROM part, (VALUES ('word/document.xml'), ('word/header1.xml')) t(part) WHERE p_partkey % 10 > 0")
def _(spark, sf):
    packages = parts(spark, sf, "p_size", "p_name").select(F.col("p_partkey").alias("doc_id"), _zipped(F.expr(_XML), F.expr("p_partkey % 10 = 0")).alias("content"))
    return D.docx_parts(packages).select("doc_id", "part")


@plan("s6_docx_runs", """SELECT p_partkey AS doc_id, p_name AS text, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'FF0000' END AS fg, CASE WHEN p_size > 0 THEN CAST(p_size AS VARCHAR) END AS size FROM part""")
def _(spark, sf):
    runs = D.docx_runs(_nodes(spark, sf)).filter("sz IS NOT NULL")
    return J.with_style_id(runs).select("doc_id", "text", "fg", "size")


@plan(
    "s6_docx_paragraphs",
    """SELECT p_partkey AS doc_id, 'Caption' AS style, CASE WHEN p_partkey % 2 = 0 THEN 'center' ELSE 'both' END AS jc, CASE WHEN p_size > 0 THEN p_size END AS indent_twips, CAST(NULL AS INT) AS ilvl, p_partkey % 5 = 0 AS has_seq, false AS in_cell FROM part
    UNION ALL SELECT p_partkey, NULL, NULL, NULL, CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 2 THEN 0 END, false, true FROM part""",
)
def _(spark, sf):
    return D.docx_paragraphs(_nodes(spark, sf)).drop("part", "pos")


@plan("s6_docx_tables", "SELECT p_partkey AS doc_id, 'dxa' AS width_type, CAST(p_size * 100 AS VARCHAR) AS width, 'end' AS jc, 2 AS n_grid_cols FROM part")
def _(spark, sf):
    return D.docx_tables(_nodes(spark, sf)).drop("part", "pos", "close_pos")


@plan("s6_docx_cells", "SELECT p_partkey AS doc_id, '2' AS grid_span, '00FF00' AS bg FROM part WHERE p_partkey % 4 > 0")
def _(spark, sf):
    return J.tagged_cells(D.docx_cells(_nodes(spark, sf))).select("doc_id", "grid_span", "bg")


@plan("s6_docx_sections", "SELECT p_partkey AS doc_id, p_size + 100 AS w, 200 AS h, 'h1' AS headers, '' AS footers, true AS title_pg FROM part")
def _(spark, sf):
    s = D.docx_sections(_nodes(spark, sf))
    return s.select("doc_id", "w", "h", F.array_join("header_refs", ",").alias("headers"), F.array_join("footer_refs", ",").alias("footers"), "title_pg")


@plan("x2_rewrite_parts", "SELECT p_partkey AS doc_id, p_partkey % 3 = 0 AS changed FROM part")
def _(spark, sf):
    def drop_auto(xml: bytes) -> tuple[bytes, bool]:
        return xml.replace(b'w:val="auto"', b""), b'w:val="auto"' in xml

    return D.rewrite_parts(_parts(spark, sf), drop_auto).select("doc_id", "changed")
