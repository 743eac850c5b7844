"""Captions, listings, sections, lists and headings of block tables ``(doc_id, pos, ...)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkshard.functions import constants as K
from inkshard.functions.policy import caption_kind, placeholder_kind
from inkshard.operators.ordered import Scan, over_groups
from inkshard.session import saved, written

DOC = ["doc_id"]
POS = ["pos"]
LISTING_PART = 10_000


def document_order(df: DataFrame) -> DataFrame:
    return df.orderBy("doc_id", "pos")


def first_match(df: DataFrame, keys: Sequence[str], value: str, pred: Column, order: str = "pos") -> DataFrame:
    """First value, in order, among the rows where ``pred`` holds; groups without one are left out."""
    return df.filter(pred).groupBy(*keys).agg(F.min_by(value, order).alias(value))


# Captions and listings.


def skipped_between(kind: Column, text: Column) -> Column:
    """Rows that may stand between a caption and its table."""
    blank = ~F.coalesce(text, F.lit("")).rlike(r"\S")
    return kind.isin("bookmark", "sectPr") | (kind.isin("para", "caption") & blank)


def content_kind() -> Column:
    """Kind of a block that is content, null for what is skipped."""
    return F.when(~skipped_between(F.col("kind"), F.col("text")), F.col("kind"))


def caption_table_adjacency(blocks: DataFrame, **limits) -> DataFrame:
    """Caption rows with the kind of the next content block and whether that is a table."""
    out = over_groups(blocks, DOC, POS, lambda df, scan: scan.together(df, following={"next_kind": ("last", content_kind())}), **limits).filter(F.col("kind") == "caption")
    return out.withColumn("before_table", F.coalesce(F.col("next_kind") == "table", F.lit(False)))


def number_captions(blocks: DataFrame, existing_id: Column | None = None, **limits) -> DataFrame:
    """Captions with kind, bookmark and number; bookmark ids continue after the highest existing one.

    ``existing_id`` reads a bookmark id from any block of the document; ids that are not
    whole numbers are skipped.
    """
    existing = F.lit(None).cast("int") if existing_id is None else existing_id.try_cast("int")

    def body(df: DataFrame, scan: Scan) -> DataFrame:
        df = scan.together(df, following={"next_kind": ("last", content_kind())}, totals={"_base": ("max", F.greatest(existing, F.lit(0)))})
        df = df.filter(F.col("kind") == "caption").withColumn("caption_kind", caption_kind("caption_style", "next_kind", "seq_name"))
        df = written(df.select(*scan.pieces, "pos", "caption_kind", "text", "_base"))
        is_figure = F.col("caption_kind") == "figure"
        df = scan.running(df, _n=("sum", F.lit(1)), _figures=("sum", is_figure.cast("int")), _tables=("sum", (~is_figure).cast("int")))
        return df.withColumn("bookmark_id", (F.coalesce("_base", F.lit(0)) + F.col("_n")).cast("int")).withColumn(
            "seq_no", F.when(is_figure, F.col("_figures")).otherwise(F.col("_tables")).cast("int")
        )

    out = over_groups(blocks, DOC, POS, body, **limits)
    return out.select("doc_id", "pos", F.col("caption_kind").alias("kind"), F.btrim("text").alias("text"), "bookmark_id", F.format_string("_Toc%09d", "bookmark_id").alias("bookmark_name"), "seq_no")


def caption_counts(captions: DataFrame) -> DataFrame:
    return captions.groupBy("doc_id").pivot("kind", ["figure", "table"]).count().na.fill(0)


def max_ids(nodes: DataFrame, raw_id: str) -> DataFrame:
    """Highest whole-number id of each document, 0 without one."""
    return nodes.groupBy("doc_id").agg(F.coalesce(F.max(F.greatest(F.col(raw_id).try_cast("int"), F.lit(0))), F.lit(0)).alias("max_id"))


def placeholders(blocks: DataFrame, style: str = "style") -> DataFrame:
    return blocks.withColumn("kind", placeholder_kind("text", style)).filter(F.col("kind").isNotNull()).select("doc_id", "pos", "kind")


def fill_listings(found: DataFrame, captions: DataFrame) -> DataFrame:
    """Rows put in place of listing placeholders: ``(doc_id, pos, sub_pos, kind, text, bookmark_name)``.

    A contents placeholder always yields one row; figure and table ones yield a row per
    caption of their kind and vanish without any.  Captions are joined in parts of
    bounded size, so a document with a huge share of all captions is spread over tasks.
    """
    listed = captions.withColumn("kind", F.when(F.col("kind") == "figure", "tof").otherwise("tot"))
    listed = listed.withColumn("_part", F.floor((F.col("seq_no") - 1) / LISTING_PART).cast("int"))
    parts = listed.groupBy("doc_id", "kind").agg(F.max("_part").alias("_last"))
    wanted = found.filter("kind <> 'toc'").join(parts, ["doc_id", "kind"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_last")))).drop("_last")
    entries = wanted.join(listed.drop("pos"), ["doc_id", "kind", "_part"]).select("doc_id", "pos", F.col("seq_no").alias("sub_pos"), "kind", "text", "bookmark_name")
    toc = found.filter("kind = 'toc'").select("doc_id", "pos", F.lit(1).alias("sub_pos"), "kind", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("bookmark_name"))
    return entries.unionByName(toc)


def splice_blocks(blocks: DataFrame, removed: DataFrame, inserted: DataFrame) -> DataFrame:
    """Blocks with ``removed`` positions taken out and ``inserted`` rows in their place.

    Order is the pair ``(pos, sub_pos)``; rows that stay have ``sub_pos`` 0, so no edit
    moves the position of another.
    """
    stay = blocks.join(removed.select("doc_id", "pos").distinct(), ["doc_id", "pos"], "left_anti").withColumn("sub_pos", F.lit(0))
    return stay.unionByName(inserted, allowMissingColumns=True)


def splice_order(df: DataFrame) -> DataFrame:
    return df.orderBy("doc_id", "pos", "sub_pos")


def first_number_split(runs: DataFrame, keys: Sequence[str] = ("doc_id", "block_pos"), **limits) -> DataFrame:
    """The first run with a number in each caption, split into before, number and after."""
    def body(df: DataFrame, scan: Scan) -> DataFrame:
        return scan.ordinal(df.filter(F.col("text").rlike(r"\d")), "_n").filter("_n = 1")

    out = over_groups(runs, list(keys), POS, body, **limits)
    part = lambda i: F.regexp_extract("text", r"(?s)^(\D*)(\d+)(.*)$", i)
    return out.select(*keys, "pos", part(1).alias("before"), part(2).alias("number"), part(3).alias("after"))


# Sections.


def assign_sections(blocks: DataFrame, is_break: str = "is_break", **limits) -> DataFrame:
    """Section index of each block: breaks before it."""
    def body(df: DataFrame, scan: Scan) -> DataFrame:
        return scan.running(df, include_current=False, _n=("sum", F.col(is_break).cast("int")))

    return over_groups(blocks, DOC, POS, body, **limits).withColumn("section_idx", F.coalesce("_n", F.lit(0)).cast("int")).drop("_n")


def inherit_headers(sections: DataFrame, **limits) -> DataFrame:
    """Header and footer references every section shows.

    In a document of several sections whose first has none, the last one's references and
    title-page flag move to the first; a section without references shows those before it.
    """
    has = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0
    edge = lambda c: F.struct(F.col("header_refs").alias("h"), F.col("footer_refs").alias("f"), F.coalesce("title_pg", F.lit(False)).alias("t"), c.alias("at"))

    def body(df: DataFrame, scan: Scan) -> DataFrame:
        at = F.col("section_idx")
        df = scan.totals(df, _first=("first", edge(at)), _last=("last", edge(at)))
        bare = ~has("_first.h") & ~has("_first.f")
        moves = bare & (F.col("_first.at") != F.col("_last.at"))
        first, last = at == F.col("_first.at"), at == F.col("_last.at")
        none = F.array().cast("array<string>")
        pick = lambda mine, theirs, empty: F.when(moves & first, theirs).when(moves & last, empty).otherwise(mine)
        df = df.withColumns(
            {
                "header_refs": pick(F.col("header_refs"), F.col("_last.h"), none),
                "footer_refs": pick(F.col("footer_refs"), F.col("_last.f"), none),
                "title_pg": F.when(moves & first, F.coalesce("title_pg", F.lit(False)) | F.col("_last.t")).when(moves & last, F.lit(False)).otherwise(F.coalesce("title_pg", F.lit(False))),
            }
        ).drop("_first", "_last")
        return scan.running(saved(df), shown_headers=("last", F.when(has("header_refs"), F.col("header_refs"))), shown_footers=("last", F.when(has("footer_refs"), F.col("footer_refs"))))

    return over_groups(sections, DOC, ["section_idx"], body, **limits)


# Lists and headings.


def list_level(ilvl: Column, in_list: Column) -> Column:
    """Level of a list paragraph: 0 when unstated, null when it is no whole number from 0 up."""
    n = ilvl.try_cast("int")
    return F.when(in_list, F.when(ilvl.isNull(), F.lit(0)).when(n >= 0, n))


def list_push(items: DataFrame, lists: Sequence[str] = ("doc_id", "list_id"), **limits) -> DataFrame:
    """Marker-less levels to add around each list: how far its first tagged item lies below its depth.

    ``depth`` is the structural depth, counted from 1 inside every container; lists nest
    at most four deep.
    """
    out = over_groups(items, list(lists), POS, lambda df, scan: scan.totals(df, level=("first", F.col("ilvl"))), **limits)
    lift = F.coalesce(F.col("level") - (F.col("depth") - 1), F.lit(0))
    return out.withColumn("push", F.greatest(F.lit(0), F.least(lift, K.MAX_LIST_DEPTH - F.col("depth"))).cast("int"))


def heading_outline(blocks: DataFrame, level: str = "level", **limits) -> DataFrame:
    """Number of each heading, counted per level and starting anew under every shallower heading."""
    counted = {f"_l{n}": (F.col(level) == n, F.col(level) < n) for n in range(1, K.MAX_HEADING + 1)}
    out = over_groups(blocks.filter(F.col(level).isNotNull()), DOC, POS, lambda df, scan: scan.count_since(df, **counted), **limits)
    parts = F.filter(F.array(*[F.when(F.col(level) >= n, F.col(f"_l{n}")) for n in range(1, K.MAX_HEADING + 1)]), lambda c: c > 0)
    return out.withColumn("outline", F.array_join(F.transform(parts, lambda c: c.cast("string")), ".")).drop(*counted)


# Runs.


def fill_highlight_gaps(runs: DataFrame, keys: Sequence[str] = ("doc_id",), **limits) -> DataFrame:
    """A space between two runs of the same background takes it; white never bridges.

    Expects ``is_space`` and ``bg_key``, the background of a run or null.
    """
    key = F.when(~F.col("is_space") & (F.upper("bg_key") != "FFFFFF"), F.col("bg_key"))
    out = over_groups(runs, list(keys), POS, lambda df, scan: scan.neighbours(df, lag={"_left": key}, lead={"_right": key}), **limits)
    fills = F.col("is_space") & F.coalesce(F.col("_left") == F.col("_right"), F.lit(False))
    return out.withColumn("fill_key", F.when(fills, F.col("_left")).when(~F.col("is_space"), F.col("bg_key"))).drop("_left", "_right")


def math_run_colors(tokens: DataFrame, start_color: str = "start_color", is_end: str = "is_end", **limits) -> DataFrame:
    """Runs with the colour of the innermost open marker; marker rows are removed.

    The depth of open markers is a running sum that cannot go below zero; the open colour
    of a depth is the one pushed last at that depth.
    """
    start = F.col(start_color).isNotNull()

    def body(df: DataFrame, scan: Scan) -> DataFrame:
        df = scan.floored_level(df, "_depth", F.when(start, 1).when(F.col(is_end), -1).otherwise(0))
        return scan.by(*scan.keys, "_depth").running(saved(df), _open=("last", F.upper(start_color)))

    out = over_groups(tokens, DOC, POS, body, **limits).filter(~start & ~F.col(is_end))
    return out.withColumn("color", F.when(F.col("_depth") > 0, F.col("_open"))).drop("_depth", "_open")


def decoration_segments(runs: DataFrame, keys: Sequence[str] = ("doc_id", "block_pos"), **limits) -> DataFrame:
    """Decorated runs cut at line breaks, each segment wrapped underline outside strike-out.

    Expects ``text``, ``is_break``, ``underline``, ``strikeout``, ``bg`` and ``is_plain``;
    a block of plain text is left to the writer.  Backgrounds of short runs become boxes.
    """
    boxed = F.when(
        F.col("bg").isNotNull() & (F.upper("bg") != "FFFFFF") & (F.octet_length("text") <= K.MAX_BOXED_BYTES),
        F.concat(F.lit("{\\setlength{\\fboxsep}{0pt}\\colorbox[HTML]{"), F.col("bg"), F.lit("}{\\strut{}"), F.col("text"), F.lit("}}")),
    ).otherwise(F.col("text"))

    def body(df: DataFrame, scan: Scan) -> DataFrame:
        whole = {"_all_plain": ("min", F.col("is_plain")), "_u": ("max", F.col("underline")), "_s": ("max", F.col("strikeout"))}
        df = scan.together(df, running={"segment": ("sum", F.col("is_break").cast("int"))}, totals=whole)
        lines = df.filter(~F.col("_all_plain") & ~F.col("is_break")).withColumn("_t", boxed)
        return scan.by(*scan.keys, "segment", "_u", "_s").joined_text(lines, "_t")

    out = over_groups(runs, list(keys), POS, body, **limits)
    # A segment in several parts is wrapped once, around all of them.
    of_segment = Window.partitionBy(*keys, "segment")
    starts = F.col("part") == F.min("part").over(of_segment)
    ends = F.col("part") == F.max("part").over(of_segment)
    wrapped = F.concat(
        F.when(starts & F.col("_u"), "\\uline{").otherwise(""),
        F.when(starts & F.col("_s"), "\\sout{").otherwise(""),
        F.col("text"),
        F.when(ends & F.col("_s"), "}").otherwise(""),
        F.when(ends & F.col("_u"), "}").otherwise(""),
    )
    return out.select(*keys, F.col("segment").cast("int").alias("segment"), (F.col("part") - F.min("part").over(of_segment)).alias("part"), wrapped.alias("text"))
