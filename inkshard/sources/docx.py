"""Office packages opened into parts, nodes and property tables.

Only two Python leaves: one unzips packages, one walks a part's XML.  Everything after
is aggregation over node rows, keyed finely enough (run, paragraph, table) to spread.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkshard.operators.structure import list_level
from inkshard.sources.shred import shred

# Parts that hold body content.
BODY_PARTS = ["word/document.xml", "word/footnotes.xml", "word/endnotes.xml", "word/comments.xml"]
STYLES_PART = "word/styles.xml"


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, content)``, one row per package file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "content")


def docx_parts(packages: DataFrame) -> DataFrame:
    """``(doc_id, part, xml)`` of body parts and styles; anything that is no zip gives no rows."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("xml", pa.binary())])

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, content in zip(batch.column("doc_id"), batch.column("content")):
                try:
                    package = zipfile.ZipFile(io.BytesIO(content.as_py() or b""))
                except zipfile.BadZipFile:
                    continue
                # One batch per package keeps a task's memory at one package.
                names = [n for n in package.namelist() if n.startswith("word/") and n.endswith(".xml")]
                rows = [[doc_id.as_py()] * len(names), names, [package.read(n) for n in names]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, schema.types)], schema=schema)

    parts = packages.select("doc_id", "content").mapInArrow(unzip, "doc_id bigint, part string, xml binary")
    return parts.filter(is_body_part("part") | (F.col("part") == STYLES_PART))


def is_body_part(part: str) -> Column:
    return F.col(part).isin(BODY_PARTS) | F.col(part).rlike(r"^word/(header|footer).*\.xml$")


XML_NODE = (
    "pos int, close_pos int, depth int, parent_pos int, parent_tag string, tag string, attrs map<string,string>, text string, "
    "r_pos int, p_pos int, tc_pos int, tr_pos int, tbl_pos int, sect_pos int"
)
_HOLDERS = ("r", "p", "tc", "tr", "tbl", "sectPr")


def _parse(xml: bytes) -> list[list]:
    """Elements in document order, each with the nearest run, paragraph, cell, row, table and section."""
    # A document type may pull in files or explode; such parts are skipped like broken ones.
    if b"<!DOCTYPE" in xml or b"<!ENTITY" in xml:
        return []
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return []
    name = lambda n: n.rpartition("}")[2]
    pos, done, todo = 0, [], [(root, None, dict.fromkeys(_HOLDERS))]
    # An explicit stack, since office documents nest deeper than Python likes to recurse.
    while todo:
        item = todo.pop()
        if isinstance(item, list):
            item[1] = pos
            pos += 1
            continue
        el, parent, around = item
        tag = name(el.tag)
        node = [pos, None, 1 + (parent[2] if parent else 0), parent[0] if parent else None, parent[5] if parent else None, tag, {name(k): v for k, v in el.attrib.items()}, el.text or ""]
        around = {**around, tag: pos} if tag in around else around
        node += [around[h] for h in _HOLDERS]
        done.append(node)
        pos += 1
        todo.append(node)
        todo.extend((child, node, around) for child in reversed(el))
    return done


def docx_nodes(parts: DataFrame) -> DataFrame:
    """Element rows of every part."""
    return shred(parts, "xml", _parse, XML_NODE)


def _value(tag: str, parent: str, attr: str = "val") -> Column:
    """Attribute of the first such property; null without one."""
    hit = (F.col("tag") == tag) & (F.col("parent_tag") == parent)
    return F.min_by(F.col("attrs")[attr], F.when(hit, F.col("pos")))


def docx_runs(nodes: DataFrame) -> DataFrame:
    """Runs with text and raw properties, ready for style ids."""
    runs = nodes.filter(F.col("r_pos").isNotNull()).groupBy("doc_id", "part", "p_pos", F.col("r_pos").alias("pos"))
    text = F.array_sort(F.collect_list(F.when(F.col("tag") == "t", F.struct("pos", "text"))))
    return runs.agg(
        F.array_join(F.transform(text, lambda t: t["text"]), "").alias("text"),
        _value("color", "rPr").alias("color"),
        _value("shd", "rPr", "fill").alias("fill"),
        _value("highlight", "rPr").alias("highlight"),
        _value("sz", "rPr").alias("sz"),
        _value("szCs", "rPr").alias("sz_cs"),
    )


def docx_paragraphs(nodes: DataFrame) -> DataFrame:
    """Paragraphs with style, alignment, indent, list level, and whether they number themselves or sit in a cell."""
    rows = nodes.filter(F.col("p_pos").isNotNull()).groupBy("doc_id", "part", F.col("p_pos").alias("pos"))
    in_list = F.bool_or((F.col("tag") == "numPr") & (F.col("parent_tag") == "pPr"))
    seq = F.bool_or((F.col("tag") == "instrText") & F.upper("text").contains("SEQ") | ((F.col("tag") == "fldSimple") & F.upper(F.col("attrs")["instr"]).contains("SEQ")))
    left = _value("ind", "pPr", "left").try_cast("int")
    return rows.agg(
        _value("pStyle", "pPr").alias("style"),
        _value("jc", "pPr").alias("jc"),
        F.when(left > 0, left).alias("indent_twips"),
        list_level(_value("ilvl", "numPr"), in_list).alias("ilvl"),
        F.coalesce(seq, F.lit(False)).alias("has_seq"),
        F.bool_or(F.col("tc_pos").isNotNull()).alias("in_cell"),
    )


def docx_tables(nodes: DataFrame) -> DataFrame:
    rows = nodes.filter(F.col("tbl_pos").isNotNull()).groupBy("doc_id", "part", F.col("tbl_pos").alias("pos"))
    return rows.agg(
        F.max(F.when(F.col("tag") == "tbl", F.col("close_pos"))).alias("close_pos"),
        _value("tblW", "tblPr", "type").alias("width_type"),
        _value("tblW", "tblPr", "w").alias("width"),
        _value("jc", "tblPr").alias("jc"),
        F.count_if(F.col("tag") == "gridCol").cast("int").alias("n_grid_cols"),
    )


def docx_cells(nodes: DataFrame) -> DataFrame:
    rows = nodes.filter(F.col("tc_pos").isNotNull()).groupBy("doc_id", "part", "tbl_pos", "tr_pos", F.col("tc_pos").alias("pos"))
    return rows.agg(_value("gridSpan", "tcPr").alias("grid_span"), _value("shd", "tcPr", "fill").alias("fill"))


def docx_sections(nodes: DataFrame) -> DataFrame:
    rows = nodes.filter(F.col("sect_pos").isNotNull()).groupBy("doc_id", "part", F.col("sect_pos").alias("pos"))
    refs = lambda tag: F.array_sort(F.collect_set(F.when(F.col("tag") == tag, F.col("attrs")["id"])))
    number = lambda a: _value("pgSz", "sectPr", a).try_cast("int")
    return rows.agg(
        number("w").alias("w"),
        number("h").alias("h"),
        _value("pgSz", "sectPr", "orient").alias("orient"),
        refs("headerReference").alias("header_refs"),
        refs("footerReference").alias("footer_refs"),
        F.bool_or(F.col("tag") == "titlePg").alias("title_pg"),
    )


def rewrite_parts(parts: DataFrame, *rewrites: Callable[[bytes], tuple[bytes, bool]]) -> DataFrame:
    """Parts passed through user functions ``xml -> (xml, changed)``, in order, with a ``changed`` flag."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, flags = [], []
            for xml in pdf["xml"]:
                changed = False
                for fn in rewrites:
                    xml, hit = fn(bytes(xml))
                    changed |= hit
                out.append(xml)
                flags.append(changed)
            yield pdf.assign(xml=out, changed=flags)

    return parts.select("doc_id", "part", "xml").mapInPandas(run, "doc_id bigint, part string, xml binary, changed boolean")
