"""Blocks rendered to plain text, Markdown, Textile or HTML."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from inkshard.functions.text import escape_xml
from inkshard.operators.ordered import Scan, over_groups
from inkshard.operators.text import PART
from inkshard.session import saved
from inkshard.sources.html import page_segments

DIALECTS = ("plain", "markdown", "textile", "html")
_BOLD = {"plain": "$1", "markdown": "**$1**", "textile": "*$1*", "html": "\x06$1\x07"}


def slug(text: Column) -> Column:
    return F.replace(F.lower(F.replace(text, F.lit("*"), F.lit(""))), F.lit(" "), F.lit("-"))


def render_block(dialect: str, kind: Column, level: Column, number: Column, text: Column) -> Column:
    """One block in a dialect; kinds are header, ordered, bullet and para."""
    n = F.coalesce(number, F.lit(1)).cast("string")
    if dialect == "plain":
        return F.when(kind == "ordered", F.concat(n, F.lit(".  "), text)).when(kind == "bullet", F.concat(F.lit("-   "), text)).otherwise(text)
    if dialect == "markdown":
        return (
            F.when(kind == "header", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text))
            .when(kind == "ordered", F.concat(n, F.lit(".  "), text))
            .when(kind == "bullet", F.concat(F.lit("-   "), text))
            .otherwise(text)
        )
    if dialect == "textile":
        return (
            F.when(kind == "header", F.concat(F.lit("h"), level.cast("string"), F.lit("(#"), slug(text), F.lit("). "), text))
            .when(kind == "ordered", F.concat(F.lit("# "), text))
            .when(kind == "bullet", F.concat(F.lit("* "), text))
            .otherwise(text)
        )
    safe = F.replace(F.replace(escape_xml(text), F.lit("\x06"), F.lit("<strong>")), F.lit("\x07"), F.lit("</strong>"))
    wrap = lambda tag: F.concat(F.lit("<"), tag, F.lit(">"), safe, F.lit("</"), tag, F.lit(">"))
    return F.when(kind == "header", wrap(F.concat(F.lit("h"), level.cast("string")))).when(kind.isin("ordered", "bullet"), wrap(F.lit("li"))).otherwise(wrap(F.lit("p")))


def _is_item(kind: Column) -> Column:
    return F.coalesce(kind.isin("ordered", "bullet"), F.lit(False))


def _separator(kind: Column, previous_kind: Column, loose_lists: bool) -> Column:
    tight = _is_item(kind) & _is_item(previous_kind) & F.lit(not loose_lists)
    return F.when(previous_kind.isNull(), "").when(tight, "\n").otherwise("\n\n")


def _render_rows(df: DataFrame, scan: Scan, dialect: str, loose_lists: bool) -> DataFrame:
    df = scan.neighbours(df.filter(F.col("text") != ""), lag={"_before": F.col("kind")})
    piece = F.concat(_separator(F.col("kind"), F.col("_before"), loose_lists), render_block(dialect, F.col("kind"), F.col("level"), F.col("number"), F.col("text")))
    return scan.joined_text(df.withColumn("_piece", piece), "_piece").withColumnRenamed("n", "n_blocks")


def render_blocks(blocks: DataFrame, dialect: str, loose_lists: bool = False, part: int = PART) -> DataFrame:
    """``(doc_id, part, text, n_blocks)`` from rows ``(doc_id, pos, kind, level, number, text)``.

    Part p holds the blocks at positions from p x ``part`` on; the parts of a document join to its
    text without any separator.
    """
    out = over_groups(blocks, ["doc_id"], ["pos"], lambda df, scan: _render_rows(df, scan, dialect, loose_lists), part)
    return out.select("doc_id", "part", "text", "n_blocks")


def _number_rows(df: DataFrame, scan: Scan) -> DataFrame:
    opens, closes = F.col("tag").isin("ol", "ul"), F.col("tag").isin("/ol", "/ul")
    df = scan.floored_level(df, "depth", F.when(opens, 1).when(closes, -1).otherwise(0))
    in_list = scan.by(*scan.keys, "depth")
    df = in_list.count_since(saved(df), number=(F.col("tag") == "li", opens))
    df = in_list.running(df, list_tag=("last", F.when(opens, F.col("tag"))))
    is_item = (F.col("tag") == "li") & (F.col("depth") > 0)
    level = F.regexp_extract("tag", r"^h([1-6])$", 1).try_cast("int")
    kind = F.when(is_item, F.when(F.col("list_tag") == "ol", "ordered").otherwise("bullet")).when(level.isNotNull(), "header").otherwise("para")
    return df.withColumns({"kind": kind, "level": level, "number": F.when(is_item, F.col("number")).cast("int")})


def list_numbers(segments: DataFrame, **limits) -> DataFrame:
    """Blocks with item numbers from ``html_segments`` rows, for lists nested to any depth."""
    rows = over_groups(segments, ["doc_id"], ["pos"], _number_rows, **limits)
    return rows.select("doc_id", "pos", "kind", "level", "number", "text").filter(F.col("text") != "")


def _walk_lists(tags: list[str]) -> list[tuple[str | None, int | None]]:
    """Kind and number of the item at each tag, none where there is no item; lists nest to any depth."""
    out, lists = [], []
    for tag in tags:
        item = (None, None)
        if tag in ("ol", "ul"):
            lists.append([tag, 0])
        elif tag in ("/ol", "/ul"):
            del lists[-1:]
        elif tag == "li" and lists:
            lists[-1][1] += 1
            item = ("ordered" if lists[-1][0] == "ol" else "bullet", lists[-1][1])
        out.append(item)
    return out


@F.pandas_udf(ArrayType(StructType([StructField("kind", StringType()), StructField("number", IntegerType())])))
def _list_items(tags: pd.Series) -> pd.Series:
    return tags.map(lambda t: None if t is None else [{"kind": k, "number": n} for k, n in _walk_lists(t)])


def page_blocks(pages: DataFrame, html: str = "html", bold: str = "$1") -> DataFrame:
    """``(doc_id, blocks)``: the blocks with text of each page as an array of ``(kind, level, number, text)``.

    Only the tags of pages with ordered lists leave the JVM, to have their items numbered; without
    ordered lists every item is a bullet.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    # Step by step, so that segments are made once for the several uses below.
    rows = pages.select("doc_id", page_segments(body, bold).alias("_segments"), F.lower(body).contains("<ol").alias("_numbered"))
    rows = rows.withColumn("_items", _list_items(F.when(F.col("_numbered"), F.transform("_segments", lambda s: s["tag"]))))
    plain = F.transform("_segments", lambda s: F.struct(F.when(s["tag"] == "li", "bullet").alias("kind"), F.lit(None).cast("int").alias("number")))

    def block(segment: Column, item: Column) -> Column:
        level = F.regexp_extract(segment["tag"], "^h([1-6])$", 1).try_cast("int")
        kind = F.coalesce(item["kind"], F.when(level.isNotNull(), "header").otherwise("para"))
        return F.struct(kind.alias("kind"), level.alias("level"), item["number"].alias("number"), segment["text"].alias("text"))

    return rows.select("doc_id", F.filter(F.zip_with("_segments", F.coalesce("_items", plain), block), lambda b: b["text"] != "").alias("blocks"))


def render_array(blocks: Column, dialect: str) -> Column:
    """Text of an array of blocks, as ``page_blocks`` makes it."""
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform(F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0))), lambda b: b["kind"]))
    pieces = F.zip_with(blocks, before, lambda b, k: F.when(b.isNotNull(), F.concat(_separator(b["kind"], k, False), render_block(dialect, b["kind"], b["level"], b["number"], b["text"]))))
    return F.array_join(pieces, "")


def render_pages(pages: DataFrame, dialect: str = "plain", html: str = "html") -> DataFrame:
    """``(doc_id, part, text, n_blocks)`` of HTML pages, one row for each page, from one scan and without a shuffle.

    A page without text in any block, an empty one or a null one has the empty text and no blocks.
    """
    blocks = page_blocks(pages, html, _BOLD[dialect])
    return blocks.select("doc_id", F.lit(0).cast("bigint").alias("part"), render_array(F.col("blocks"), dialect).alias("text"), F.size("blocks").cast("bigint").alias("n_blocks"))
