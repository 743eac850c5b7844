"""Queries over blocks, runs, tables and their columns derived from lineitem and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkshard.functions import constants as K
from inkshard.functions.css import table_layout
from inkshard.functions.layout import apply_layout
from inkshard.functions.policy import caption_kind, heading_level, page_command
from inkshard.functions.styles import neutral_caption_style, normalize_first_paragraph, paragraph_style_id
from inkshard.operators import joins as J
from inkshard.operators import nodes as N
from inkshard.operators import structure as S
from inkshard.operators import tables as T
from inkshard.operators.text import join_text
from inkshard.plans.registry import plan, table
from inkshard.plans.views import _POS, DOC_BLOCKS, RAW_RUNS, STYLED_RUNS, TABLE_COLS, doc_blocks, lines, raw_runs, styled_runs, styled_tables, table_cols
from inkshard.session import written

BLOCKS = f"WITH b AS ({DOC_BLOCKS})"

# Captions: next content block, kind, numbers.

_SKIP = "(kind IN ('caption', 'para') AND text = '')"
_NEXT = f"""x AS (SELECT *, first_value(CASE WHEN NOT {_SKIP} THEN kind END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_kind FROM b)"""
_KIND = """CASE WHEN caption_style = 'ImageCaption' THEN 'figure' WHEN caption_style = 'TableCaption' OR coalesce(next_kind, '') = 'table' THEN 'table'
 WHEN seq_name IS NULL OR seq_name = 'Figure' THEN 'figure' ELSE 'table' END"""
_CAPTIONS = f"""{_NEXT}, base AS (SELECT doc_id, max(CASE WHEN kind = 'para' AND heading_n > 3 THEN heading_n END) AS base FROM b GROUP BY 1),
 k AS (SELECT x.doc_id, pos, {_KIND} AS kind, text, coalesce(base, 0) AS base FROM x JOIN base USING (doc_id) WHERE x.kind = 'caption'),
 c AS (SELECT doc_id, pos, kind, text, CAST(base + row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS bookmark_id,
   CAST(row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos) AS INT) AS seq_no FROM k)"""
def _captions(blocks):
    # Ids of existing bookmarks: paragraphs carry one, those below 4 spelled so that they are no numbers.
    existing = F.expr("CASE WHEN kind = 'para' THEN CASE WHEN heading_n > 3 THEN CAST(heading_n AS STRING) ELSE concat('id', heading_n) END END")
    return S.number_captions(blocks, existing)


@plan("j9_caption_table_adjacency", f"{BLOCKS}, {_NEXT} SELECT doc_id, pos, next_kind, coalesce(next_kind = 'table', false) AS before_table FROM x WHERE kind = 'caption'")
def _(spark, sf):
    return S.caption_table_adjacency(doc_blocks(spark, sf)).select("doc_id", "pos", "next_kind", "before_table")


@plan("f24_caption_kind", f"{BLOCKS}, {_NEXT} SELECT caption_style, next_kind, seq_name, {_KIND} AS kind, count(*) AS n FROM x WHERE kind = 'caption' GROUP BY ALL")
def _(spark, sf):
    near = S.caption_table_adjacency(doc_blocks(spark, sf))
    return near.groupBy("caption_style", "next_kind", "seq_name", caption_kind("caption_style", "next_kind", "seq_name").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@plan("w1_number_captions", f"{BLOCKS}, {_CAPTIONS} SELECT doc_id, pos, kind, text, bookmark_id, printf('_Toc%09d', bookmark_id) AS bookmark_name, seq_no FROM c")
def _(spark, sf):
    return _captions(doc_blocks(spark, sf))


@plan("a14_caption_counts", f"{BLOCKS}, {_CAPTIONS} SELECT doc_id, count(*) FILTER (kind = 'figure') AS figure, count(*) FILTER (kind = 'table') AS \"table\" FROM c GROUP BY 1")
def _(spark, sf):
    return S.caption_counts(_captions(doc_blocks(spark, sf)))


@plan("a10_max_ids", f"{BLOCKS} SELECT doc_id, CAST(coalesce(max(CASE WHEN heading_n > 3 THEN heading_n END), 0) AS INT) AS max_id FROM b GROUP BY 1")
def _(spark, sf):
    blocks = table(spark, sf, "lineitem").selectExpr("l_orderkey AS doc_id", "CASE WHEN l_partkey % 12 + 1 > 3 THEN CAST(l_partkey % 12 + 1 AS STRING) ELSE concat('id', l_partkey) END AS raw_id")
    return S.max_ids(blocks, "raw_id")


# Listings: some paragraphs are placeholders.
_HOLDER_TEXT = "CASE WHEN pos = 1 THEN ' TOC_PLACEHOLDER ' WHEN pos = 2 THEN 'TOF_PLACEHOLDER' WHEN pos = 3 THEN 'TOT_PLACEHOLDER' ELSE text END"
_HOLDER_STYLE = "CASE heading_n % 3 WHEN 0 THEN 'BodyText' WHEN 1 THEN 'Heading1' ELSE NULL END"
_HOLDERS = "h AS (SELECT doc_id, pos, CASE pos WHEN 1 THEN 'toc' WHEN 2 THEN 'tof' ELSE 'tot' END AS kind FROM b WHERE pos <= 3 AND kind = 'para' AND heading_n % 3 <> 1)"
_LISTED = """l AS (SELECT h.doc_id, h.pos, c.seq_no AS sub_pos, h.kind, c.text, printf('_Toc%09d', c.bookmark_id) AS bookmark_name
 FROM h JOIN c ON h.doc_id = c.doc_id AND c.kind = CASE h.kind WHEN 'tof' THEN 'figure' ELSE 'table' END WHERE h.kind <> 'toc'
 UNION ALL SELECT doc_id, pos, 1, kind, NULL, NULL FROM h WHERE kind = 'toc')"""


def _holders(blocks):
    return S.placeholders(blocks.filter("kind = 'para'").selectExpr("doc_id", "pos", f"{_HOLDER_TEXT} AS text", f"{_HOLDER_STYLE} AS style"))


def _listings(spark, sf):
    """Blocks, placeholders among them, and what takes their place. Blocks and placeholders are written once for all that read them."""
    blocks = written(doc_blocks(spark, sf).select("doc_id", "pos", "kind", "caption_style", "seq_name", "text", "heading_n"))
    holders = written(_holders(blocks))
    return blocks, holders, S.fill_listings(holders, _captions(blocks))


@plan("p14_is_placeholder", f"{BLOCKS}, {_HOLDERS} SELECT doc_id, pos, kind FROM h")
def _(spark, sf):
    return _holders(doc_blocks(spark, sf))


@plan("j10_fill_listings", f"{BLOCKS}, {_CAPTIONS}, {_HOLDERS}, {_LISTED} SELECT * FROM l")
def _(spark, sf):
    return _listings(spark, sf)[2]


@plan(
    "u2_splice_blocks",
    f"""{BLOCKS}, {_CAPTIONS}, {_HOLDERS}, {_LISTED} SELECT doc_id, pos, 0 AS sub_pos, kind, text FROM b WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = b.doc_id AND h.pos = b.pos)
    UNION ALL SELECT doc_id, pos, sub_pos, kind, text FROM l""",
)
def _(spark, sf):
    blocks, holders, inserted = _listings(spark, sf)
    return S.splice_blocks(blocks.select("doc_id", "pos", "kind", "text"), holders, inserted.drop("bookmark_name"))


@plan("o1_document_order", f"{BLOCKS} SELECT doc_id, pos, kind, text FROM b ORDER BY doc_id, pos")
def _(spark, sf):
    return S.document_order(doc_blocks(spark, sf).select("doc_id", "pos", "kind", "text"))


@plan(
    "o2_splice_order",
    f"""{BLOCKS}, {_CAPTIONS}, {_HOLDERS}, {_LISTED} SELECT doc_id, pos, 0 AS sub_pos, kind FROM b WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = b.doc_id AND h.pos = b.pos)
    UNION ALL SELECT doc_id, pos, sub_pos, kind FROM l ORDER BY doc_id, pos, sub_pos""",
)
def _(spark, sf):
    blocks, holders, inserted = _listings(spark, sf)
    spliced = S.splice_blocks(blocks.select("doc_id", "pos", "kind"), holders, inserted.select("doc_id", "pos", "sub_pos", "kind"))
    # Ranges come from a sample: without this the rows would be spliced once for it and once for the order.
    return S.splice_order(written(spliced))


@plan("o3_first_match", f"{BLOCKS} SELECT doc_id, arg_min(text, pos) AS text FROM b WHERE regexp_matches(text, '[0-9]') AND kind = 'caption' GROUP BY 1")
def _(spark, sf):
    return S.first_match(doc_blocks(spark, sf), ["doc_id"], "text", (F.col("kind") == "caption") & F.col("text").rlike("[0-9]"))


# Sections.


@plan("w2_assign_sections", f"{BLOCKS} SELECT doc_id, pos, CAST(coalesce(sum(CAST(is_break AS INT)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS section_idx FROM b")
def _(spark, sf):
    return S.assign_sections(doc_blocks(spark, sf)).select("doc_id", "pos", "section_idx")


_SECTIONS = "SELECT doc_id, pos - 1 AS section_idx, CASE WHEN heading_n < 4 THEN concat('h', CAST(pos AS STRING)) END AS h, CASE WHEN heading_n = 4 THEN concat('f', CAST(pos AS STRING)) END AS f, heading_n % 2 = 0 AS t FROM b"


@plan(
    "w3_inherit_headers",
    f"""{BLOCKS}, s AS ({_SECTIONS}), e AS (SELECT *, count(*) OVER d AS n, first_value(h) OVER o AS fh, first_value(f) OVER o AS ff, last_value(h) OVER o AS lh, last_value(f) OVER o AS lf, last_value(t) OVER o AS lt
      FROM s WINDOW d AS (PARTITION BY doc_id), o AS (PARTITION BY doc_id ORDER BY section_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    m AS (SELECT *, n > 1 AND fh IS NULL AND ff IS NULL AS moves FROM e),
    r AS (SELECT doc_id, section_idx, CASE WHEN moves AND section_idx = 0 THEN lh WHEN moves AND section_idx = n - 1 THEN NULL ELSE h END AS h,
      CASE WHEN moves AND section_idx = 0 THEN lf WHEN moves AND section_idx = n - 1 THEN NULL ELSE f END AS f,
      CASE WHEN moves AND section_idx = 0 THEN t OR lt WHEN moves AND section_idx = n - 1 THEN false ELSE t END AS title_pg FROM m)
    SELECT doc_id, section_idx, coalesce(h, '') AS headers, coalesce(f, '') AS footers, title_pg, last_value(h IGNORE NULLS) OVER w AS shown_headers, last_value(f IGNORE NULLS) OVER w AS shown_footers
    FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY section_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def _(spark, sf):
    refs = lambda c: F.array_compact(F.array(F.expr(c)))
    sections = doc_blocks(spark, sf).select(
        "doc_id",
        (F.col("pos") - 1).alias("section_idx"),
        refs("CASE WHEN heading_n < 4 THEN concat('h', pos) END").alias("header_refs"),
        refs("CASE WHEN heading_n = 4 THEN concat('f', pos) END").alias("footer_refs"),
        (F.col("heading_n") % 2 == 0).alias("title_pg"),
    )
    text = lambda c: F.array_join(c, ",")
    out = S.inherit_headers(sections)
    return out.select("doc_id", "section_idx", text("header_refs").alias("headers"), text("footer_refs").alias("footers"), "title_pg", text("shown_headers").alias("shown_headers"), text("shown_footers").alias("shown_footers"))


# Lists and headings.


@plan(
    "w5_list_push",
    f"""{BLOCKS}, i AS (SELECT doc_id, pos, CAST(least(pos, 4) AS INT) AS depth, CASE WHEN heading_n <> 5 THEN ilvl END AS ilvl FROM b),
    l AS (SELECT *, first_value(ilvl IGNORE NULLS) OVER (PARTITION BY doc_id, depth ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level FROM i)
    SELECT doc_id, pos, depth, level, CAST(greatest(0, least(coalesce(level - (depth - 1), 0), 4 - depth)) AS INT) AS push FROM l""",
)
def _(spark, sf):
    items = doc_blocks(spark, sf).selectExpr("doc_id", "pos", "CAST(least(pos, 4) AS INT) AS depth", "CAST(least(pos, 4) AS INT) AS list_id", "CASE WHEN heading_n <> 5 THEN ilvl END AS ilvl")
    return S.list_push(items).select("doc_id", "pos", "depth", "level", "push")


def _outline_sql() -> str:
    levels = range(1, K.MAX_HEADING + 1)
    counts = ", ".join(f"sum(CAST(level = {n} AS INT)) OVER w AS c{n}" for n in levels)
    marks = ", ".join(f"max(CASE WHEN level < {n} THEN c{n} END) OVER w AS m{n}" for n in levels)
    parts = ", ".join(f"CASE WHEN level >= {n} AND c{n} > coalesce(m{n}, 0) THEN CAST(c{n} - coalesce(m{n}, 0) AS STRING) END" for n in levels)
    w = "WINDOW w AS (PARTITION BY doc_id ORDER BY pos)"
    return f"""{BLOCKS}, h AS (SELECT doc_id, pos, CAST(least(heading_n, 9) AS INT) AS level FROM b WHERE kind = 'para' OR heading_n > 6),
    c AS (SELECT *, {counts} FROM h {w}), m AS (SELECT *, {marks} FROM c {w}) SELECT doc_id, pos, level, concat_ws('.', {parts}) AS outline FROM m"""


@plan("w19_heading_outline", _outline_sql())
def _(spark, sf):
    blocks = doc_blocks(spark, sf)
    kind = F.when(F.col("kind") == "para", "header").otherwise("div")
    level = heading_level(kind, "heading_n", F.array(F.concat(F.lit("heading-"), F.col("heading_n").cast("string"))))
    return S.heading_outline(blocks.withColumn("level", level)).select("doc_id", "pos", "level", "outline")


@plan(
    "p9_heading_level",
    "SELECT kind, heading_n, CASE WHEN kind = 'header' THEN least(heading_n, 9) WHEN kind = 'div' AND heading_n > 6 THEN least(heading_n, 9) END AS level, count(*) AS n FROM (SELECT CASE l_returnflag WHEN 'R' THEN 'header' WHEN 'A' THEN 'div' ELSE 'para' END AS kind, CAST(l_partkey % 12 + 1 AS INT) AS heading_n FROM lineitem) GROUP BY ALL",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("CASE l_returnflag WHEN 'R' THEN 'header' WHEN 'A' THEN 'div' ELSE 'para' END AS kind", "CAST(l_partkey % 12 + 1 AS INT) AS heading_n")
    classes = F.array(F.lit("note"), F.concat(F.lit("heading-"), F.col("heading_n").cast("string")))
    return rows.groupBy("kind", "heading_n", heading_level("kind", "heading_n", classes).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@plan(
    "p10_page_command",
    """WITH t AS (SELECT l_partkey % 5 AS c, l_suppkey % 2 = 0 AS is_raw FROM lineitem)
    SELECT c, is_raw, CASE WHEN c = 1 OR (c = 0 AND NOT is_raw) THEN 'page' WHEN c = 3 OR (c = 2 AND NOT is_raw) THEN 'section' END AS kind,
    CASE WHEN c = 3 THEN 11906 WHEN c = 2 AND NOT is_raw THEN 16838 END AS w, CASE WHEN c = 3 THEN 'portrait' WHEN c = 2 AND NOT is_raw THEN 'landscape' END AS orient, count(*) AS n FROM t GROUP BY ALL""",
)
def _(spark, sf):
    texts = F.element_at(F.array(*[F.lit(t) for t in ("go \\newpage now", "\\newpage", "\\newpage \\pageLandscape", "\\pagePortrait", "text")]), (F.col("c") + 1).cast("int"))
    rows = table(spark, sf, "lineitem").selectExpr("l_partkey % 5 AS c", "l_suppkey % 2 = 0 AS is_raw").withColumn("p", page_command(texts, F.col("is_raw")))
    return rows.groupBy("c", "is_raw", F.col("p.kind").alias("kind"), F.col("p.w").alias("w"), F.col("p.orient").alias("orient")).agg(F.count(F.lit(1)).alias("n"))


@plan(
    "p8_normalize_first_paragraph",
    "SELECT CASE l_suppkey % 3 WHEN 1 THEN 'Heading1' ELSE 'BodyText' END AS style, count(*) AS n FROM lineitem GROUP BY 1",
)
def _(spark, sf):
    style = F.expr("CASE l_suppkey % 3 WHEN 0 THEN 'FirstParagraph' WHEN 1 THEN 'Heading1' ELSE 'BodyText' END")
    return table(spark, sf, "lineitem").groupBy(normalize_first_paragraph(style).alias("style")).agg(F.count(F.lit(1)).alias("n"))


@plan(
    "f38_neutral_caption_style",
    "SELECT CASE WHEN l_suppkey % 4 >= 2 AND NOT l_partkey % 6 IN (0, 1) THEN NULL ELSE CASE l_suppkey % 4 WHEN 0 THEN 'ImageCaption' WHEN 1 THEN 'TableCaption' ELSE 'Caption' END END AS style, count(*) AS n FROM lineitem GROUP BY 1",
)
def _(spark, sf):
    style = F.expr("CASE l_suppkey % 4 WHEN 0 THEN 'ImageCaption' WHEN 1 THEN 'TableCaption' ELSE 'Caption' END")
    return table(spark, sf, "lineitem").groupBy(neutral_caption_style(style, F.expr("l_partkey % 6 IN (0, 1)")).alias("style")).agg(F.count(F.lit(1)).alias("n"))


# Runs.

_FG = "CASE WHEN color IN ('ff0000', '#FF0000') THEN 'FF0000' END"
_STYLED = f"""s AS (SELECT doc_id, {_FG} AS fg, fill AS bg, nullif(highlight, 'none') AS hl, CASE WHEN sz <> '0' THEN sz END AS size, CAST(NULL AS VARCHAR) AS size_cs FROM r),
 i AS (SELECT *, CASE WHEN coalesce(fg, bg, hl, size) IS NOT NULL THEN concat_ws('__', 'FolioColor', 'FG_' || fg, 'BG_' || bg, 'HL_' || hl, 'SZ_' || size) END AS style_id FROM s)"""
def _runs(spark, sf):
    return raw_runs(spark, sf).withColumn("sz_cs", F.lit(None).cast("string"))


@plan("a9_style_registry", f"WITH r AS ({RAW_RUNS}), {_STYLED} SELECT doc_id, style_id, fg, bg, hl, size, size_cs, count(*) AS uses FROM i WHERE style_id IS NOT NULL GROUP BY ALL")
def _(spark, sf):
    return J.style_registry(_runs(spark, sf))


_EXISTING_STYLES = "x AS (SELECT DISTINCT doc_id, style_id FROM i WHERE style_id IS NOT NULL AND doc_id % 2 = 0 AND fg IS NOT NULL)"


def _needed_existing(spark, sf):
    """Styles that runs need, a row for each run, and those that documents have already."""
    needed = J.with_style_id(_runs(spark, sf)).filter("style_id IS NOT NULL").select("doc_id", "style_id", "fg")
    return needed.drop("fg"), needed.filter("doc_id % 2 = 0 AND fg IS NOT NULL").drop("fg").distinct()


@plan("j5_missing_styles", f"WITH r AS ({RAW_RUNS}), {_STYLED}, {_EXISTING_STYLES} SELECT DISTINCT doc_id, style_id FROM i WHERE style_id IS NOT NULL AND NOT (doc_id % 2 = 0 AND fg IS NOT NULL)")
def _(spark, sf):
    needed, existing = _needed_existing(spark, sf)
    return J.missing_styles(needed.distinct(), existing)


@plan("u1_augment_styles", f"WITH r AS ({RAW_RUNS}), {_STYLED} SELECT DISTINCT doc_id, style_id FROM i WHERE style_id IS NOT NULL")
def _(spark, sf):
    needed, existing = _needed_existing(spark, sf)
    return J.augment_styles(existing, needed)


_GAPS = f"""WITH r AS ({STYLED_RUNS}), k AS (SELECT doc_id, pos, is_space, CASE WHEN NOT is_space THEN fill END AS bg_key FROM r),
 n AS (SELECT *, lag(nullif(bg_key, 'FFFFFF')) OVER w AS l, lead(nullif(bg_key, 'FFFFFF')) OVER w AS r FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
 SELECT doc_id, pos, is_space, CASE WHEN is_space AND l = r THEN l WHEN NOT is_space THEN bg_key END AS fill_key FROM n"""


@plan("w6_fill_highlight_gaps", _GAPS)
def _(spark, sf):
    runs = styled_runs(spark, sf).selectExpr("doc_id", "pos", "is_space", "CASE WHEN NOT is_space THEN fill END AS bg_key")
    return S.fill_highlight_gaps(runs).drop("bg_key")


_MATH_RUNS = "SELECT doc_id, pos, CASE WHEN heading_n IN (1, 2, 3) THEN concat('aa', CAST(heading_n AS STRING), '000') END AS start_color, heading_n IN (4, 5, 6) AS is_end FROM b"


@plan(
    "w7_math_run_colors",
    f"""{BLOCKS}, t AS ({_MATH_RUNS}), a AS (SELECT *, sum(CASE WHEN start_color IS NOT NULL THEN 1 WHEN is_end THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS s FROM t),
    d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY pos)) AS depth FROM a),
    c AS (SELECT *, last_value(upper(start_color) IGNORE NULLS) OVER (PARTITION BY doc_id, depth ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o FROM d)
    SELECT doc_id, pos, CASE WHEN depth > 0 THEN o END AS color FROM c WHERE start_color IS NULL AND NOT is_end""",
)
def _(spark, sf):
    tokens = doc_blocks(spark, sf).selectExpr("doc_id", "pos", "CASE WHEN heading_n IN (1, 2, 3) THEN concat('aa', heading_n, '000') END AS start_color", "heading_n IN (4, 5, 6) AS is_end")
    return S.math_run_colors(tokens).select("doc_id", "pos", "color")


_DECO = "SELECT l_orderkey AS doc_id, pos, CASE WHEN l_partkey % 7 = 0 THEN '' ELSE concat('r', CAST(l_partkey AS STRING)) END AS text, l_partkey % 7 = 0 AS is_break, l_orderkey % 2 = 0 AS underline, l_orderkey % 3 = 0 AS strikeout, CASE l_suppkey % 4 WHEN 0 THEN 'FFFF00' WHEN 1 THEN 'FFFFFF' END AS bg"


@plan(
    "w14_decoration_segments",
    rf"""WITH b AS ({STYLED_RUNS.replace("SELECT l_orderkey AS doc_id", "SELECT l_partkey, l_suppkey, l_orderkey")}), r AS ({_DECO} FROM b),
    p AS (SELECT *, bg IS NULL AND NOT is_break AS is_plain FROM r), a AS (SELECT *, bool_and(is_plain) OVER (PARTITION BY doc_id) AS all_plain FROM p),
    s AS (SELECT *, CAST(sum(CAST(is_break AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS segment FROM a WHERE NOT all_plain)
    SELECT doc_id, segment, CAST(0 AS BIGINT) AS part, CASE WHEN underline THEN '\uline{{' ELSE '' END || CASE WHEN strikeout THEN '\sout{{' ELSE '' END ||
      string_agg(CASE WHEN bg = 'FFFF00' THEN '{{\setlength{{\fboxsep}}{{0pt}}\colorbox[HTML]{{FFFF00}}{{\strut{{}}' || text || '}}}}' ELSE text END, '' ORDER BY pos)
      || CASE WHEN strikeout THEN '}}' ELSE '' END || CASE WHEN underline THEN '}}' ELSE '' END AS text
    FROM s WHERE NOT is_break GROUP BY doc_id, segment, underline, strikeout""",
)
def _(spark, sf):
    runs = lines(spark, sf).selectExpr(
        "l_orderkey AS doc_id",
        "pos",
        "CASE WHEN l_partkey % 7 = 0 THEN '' ELSE concat('r', l_partkey) END AS text",
        "l_partkey % 7 = 0 AS is_break",
        "l_orderkey % 2 = 0 AS underline",
        "l_orderkey % 3 = 0 AS strikeout",
        "CASE l_suppkey % 4 WHEN 0 THEN 'FFFF00' WHEN 1 THEN 'FFFFFF' END AS bg",
    )
    runs = runs.withColumn("is_plain", F.col("bg").isNull() & ~F.col("is_break"))
    return S.decoration_segments(written(runs), ["doc_id"])


@plan("w20_first_number_split", f"""{BLOCKS}, f AS (SELECT doc_id, pos, text, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM b WHERE regexp_matches(text, '[0-9]'))
    SELECT doc_id, pos, 'Item ' AS before, regexp_extract(text, '[0-9]+') AS number, ' text' AS after FROM f WHERE n = 1""")
def _(spark, sf):
    return S.first_number_split(doc_blocks(spark, sf).select("doc_id", "pos", "text"), ["doc_id"])


@plan("a12_paragraph_text", f"{BLOCKS} SELECT doc_id, CAST(0 AS BIGINT) AS part, string_agg(text, '' ORDER BY pos) AS text, count(*) AS n FROM b GROUP BY 1")
def _(spark, sf):
    return join_text(doc_blocks(spark, sf), ["doc_id"], ["pos"], "text")


@plan(
    "j6_resolve_placeholders",
    f"""{BLOCKS}, r AS (SELECT doc_id, pos, heading_n, CASE WHEN heading_n % 3 = 0 THEN 'http://x/' || heading_n END AS url FROM b),
    u AS (SELECT doc_id, url, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS n FROM r WHERE url IS NOT NULL GROUP BY 1, 2)
    SELECT r.doc_id, pos, CASE heading_n WHEN 1 THEN NULL WHEN 2 THEN 'see [image] here' ELSE 'plain' END AS text, CASE WHEN heading_n = 1 THEN 'data:image/gif;base64,R0lGODlh' END AS image,
    r.url, 'rId' || n AS rel_id, CASE WHEN r.url IS NULL THEN 'tip' END AS tooltip FROM r LEFT JOIN u ON r.doc_id = u.doc_id AND r.url = u.url""",
)
def _(spark, sf):
    runs = doc_blocks(spark, sf).selectExpr(
        "doc_id",
        "pos",
        "CASE heading_n WHEN 1 THEN '{{IMG:data:image/gif;base64,R0lGODlh}}' WHEN 2 THEN 'see {{IMG:media/a.png}} here' ELSE 'plain' END AS text",
        "CASE WHEN heading_n % 3 = 0 THEN concat('{{HREF:http://x/', heading_n, '}}') ELSE 'tip' END AS tooltip",
    )
    return J.resolve_placeholders(runs).select("doc_id", "pos", "text", "image", "url", "rel_id", "tooltip")


# Policies over blocks and images.


@plan("p4_drop_raw_tex", "SELECT l_orderkey AS doc_id, l_partkey, CASE l_partkey % 5 WHEN 0 THEN 'LaTeX' WHEN 1 THEN 'html' WHEN 2 THEN 'context' ELSE NULL END AS format FROM lineitem WHERE l_partkey % 5 NOT IN (0, 2)")
def _(spark, sf):
    blocks = table(spark, sf, "lineitem").selectExpr("l_orderkey AS doc_id", "l_partkey", "CASE l_partkey % 5 WHEN 0 THEN 'LaTeX' WHEN 1 THEN 'html' WHEN 2 THEN 'context' ELSE NULL END AS format")
    return J.drop_raw_tex(blocks, "pdf")


_SRC = "CASE WHEN l_partkey % 4 = 0 THEN 'data:image/png;base64,AA' ELSE concat('media/', CAST(l_partkey % 20 AS STRING), '.png') END"
_IMAGES = f"im AS (SELECT l_orderkey AS doc_id, l_partkey, {_SRC} AS src FROM lineitem)"
_MEDIA = "me AS (SELECT DISTINCT o_orderkey AS doc_id, 'media/' || CAST(o_custkey % 20 AS VARCHAR) || '.png' AS src FROM orders)"


def _images_media(spark, sf):
    images = table(spark, sf, "lineitem").selectExpr("l_orderkey AS doc_id", "l_partkey", f"{_SRC} AS src")
    return images, table(spark, sf, "orders").selectExpr("o_orderkey AS doc_id", "concat('media/', o_custkey % 20, '.png') AS src")


@plan("j4_drop_document_images", f"WITH {_IMAGES}, {_MEDIA} SELECT * FROM im WHERE src LIKE 'data:%' OR EXISTS (SELECT 1 FROM me WHERE me.doc_id = im.doc_id AND me.src = im.src)")
def _(spark, sf):
    return J.drop_document_images(*_images_media(spark, sf))


@plan(
    "j12_media_inventory",
    f"""WITH {_IMAGES}, {_MEDIA}, l AS (SELECT doc_id, src, count(*) AS uses FROM im GROUP BY ALL)
    SELECT coalesce(l.doc_id, me.doc_id) AS doc_id, coalesce(l.src, me.src) AS src, coalesce(uses, 0) AS uses, CASE WHEN me.src IS NULL THEN 'unresolved' WHEN l.src IS NULL THEN 'orphan' ELSE 'used' END AS state
    FROM l FULL JOIN me ON l.doc_id = me.doc_id AND l.src = me.src""",
)
def _(spark, sf):
    return J.media_inventory(*_images_media(spark, sf))


@plan("a18_part_changed", "SELECT l_orderkey AS doc_id, bool_or(l_partkey % 9 = 0) AS changed FROM lineitem GROUP BY 1")
def _(spark, sf):
    return J.part_changed(table(spark, sf, "lineitem").selectExpr("l_orderkey AS doc_id", "l_partkey % 9 = 0 AS changed"))


# Tables.

_LAYOUT = """l AS (SELECT table_id, doc_id, CAST(p_size AS DOUBLE) AS n, p_partkey % 3 AS u, p_partkey % 4 AS m FROM (SELECT p_partkey AS table_id, p_partkey % 50 AS doc_id, p_size, p_partkey FROM part)),
 y AS (SELECT table_id, doc_id, CASE u WHEN 0 THEN 'pct' ELSE 'dxa' END AS width_type, CAST(CASE u WHEN 0 THEN least(round_even(n * 50, 0), 5000) WHEN 1 THEN round_even(n * 15, 0) ELSE round_even(n * 20, 0) END AS INT) AS width_value,
 CASE m WHEN 0 THEN 'center' WHEN 3 THEN 'right' WHEN 2 THEN 'left' END AS jc, CASE m WHEN 2 THEN 360 END AS indent_twips FROM l)"""


def _layouts(spark, sf):
    styled = styled_tables(spark, sf)
    return styled.select("doc_id", "table_id", table_layout("style").alias("l")).select("doc_id", "table_id", "l.*")


@plan("f3_f4_table_layout", f"WITH {_LAYOUT} SELECT * FROM y")
def _(spark, sf):
    return _layouts(spark, sf)


_J2 = f"""WITH {_LAYOUT}, a AS (SELECT y.* EXCLUDE (table_id), row_number() OVER (PARTITION BY doc_id ORDER BY table_id) AS ordinal FROM y),
 t AS (SELECT doc_id, table_id, row_number() OVER (PARTITION BY doc_id ORDER BY table_id) AS ordinal FROM l WHERE NOT (doc_id % 3 = 0 AND table_id < 50)),
 n AS (SELECT doc_id, (SELECT count(*) FROM a WHERE a.doc_id = d.doc_id) = (SELECT count(*) FROM t WHERE t.doc_id = d.doc_id) AS matched FROM (SELECT DISTINCT doc_id FROM t) d),
 j AS (SELECT t.doc_id, t.ordinal, t.table_id, n.matched, CASE WHEN n.matched THEN a.width_type END AS width_type, CASE WHEN n.matched THEN a.width_value END AS width_value, CASE WHEN n.matched THEN a.jc END AS jc,
   CASE WHEN n.matched THEN a.indent_twips END AS indent_twips FROM t JOIN n USING (doc_id) LEFT JOIN a ON a.doc_id = t.doc_id AND a.ordinal = t.ordinal)"""


def _matched(spark, sf):
    layouts = T.table_ordinals(_layouts(spark, sf), ["table_id"]).drop("table_id")
    tables = styled_tables(spark, sf).select("doc_id", "table_id").filter("NOT (doc_id % 3 = 0 AND table_id < 50)")
    return T.apply_table_layouts(layouts, T.table_ordinals(tables, ["table_id"]))


@plan("j2_apply_table_layouts", f"{_J2} SELECT * FROM j")
def _(spark, sf):
    return _matched(spark, sf)


@plan(
    "f28_apply_layout",
    f"""{_J2}, e AS (SELECT *, CASE WHEN table_id % 5 = 0 THEN 'dxa' WHEN table_id % 5 = 1 THEN 'pct' END AS et, table_id * 10 AS ew, CASE WHEN table_id % 7 = 0 THEN 0 ELSE 300000 END AS mx FROM j)
    SELECT doc_id, ordinal, CASE WHEN width_type IS NULL AND et = 'dxa' AND ew > 0 THEN CASE WHEN mx > 0 THEN least(ew, mx // 635) ELSE ew END
      WHEN width_type = 'dxa' THEN CASE WHEN mx > 0 THEN least(width_value, mx // 635) ELSE width_value END WHEN width_type IS NOT NULL THEN width_value ELSE 5000 END AS width,
    CASE WHEN width_type IS NULL AND et = 'dxa' THEN 'dxa' WHEN width_type IS NOT NULL THEN width_type ELSE 'pct' END AS width_type,
    CASE WHEN width_type IS NULL AND et = 'dxa' THEN NULL WHEN width_type = 'dxa' THEN 'fixed' ELSE 'autofit' END AS layout_type,
    CASE WHEN NOT (width_type IS NULL AND coalesce(et, '') = 'dxa') THEN jc END AS jc, CASE WHEN NOT (width_type IS NULL AND coalesce(et, '') = 'dxa') THEN indent_twips END AS indent_twips FROM e""",
)
def _(spark, sf):
    rows = _matched(spark, sf).selectExpr("*", "CASE WHEN table_id % 5 = 0 THEN 'dxa' WHEN table_id % 5 = 1 THEN 'pct' END AS et", "table_id * 10 AS ew", "CASE WHEN table_id % 7 = 0 THEN 0 ELSE 300000 END AS mx")
    layout = F.struct("width_type", "width_value", "jc", "indent_twips")
    return rows.select("doc_id", "ordinal", apply_layout(F.col("et"), F.col("ew"), layout, F.col("mx")).alias("p")).select("doc_id", "ordinal", "p.*")


@plan("a11_table_columns", f"WITH c AS ({TABLE_COLS}), r AS (SELECT table_id, col % 3 AS r, sum(grid_span) AS n FROM c GROUP BY ALL) SELECT table_id, CAST(max(n) AS INT) AS n_cols FROM r GROUP BY 1")
def _(spark, sf):
    return T.table_columns(table_cols(spark, sf).withColumn("row", F.col("col") % 3))


@plan(
    "w8_rescale_grid",
    f"""WITH c AS ({TABLE_COLS}), s AS (SELECT *, sum(w) OVER (PARTITION BY table_id) AS t, count(*) OVER (PARTITION BY table_id) AS n FROM c)
    SELECT table_id, col, w, CAST(greatest(1, CASE WHEN t <= 0 THEN target_twips // n ELSE round_even(CAST(w AS BIGINT) * target_twips / t, 0) END) AS BIGINT) AS new_w FROM s""",
)
def _(spark, sf):
    return T.rescale_grid(table_cols(spark, sf)).select("table_id", "col", "w", "new_w")


@plan(
    "w16_column_fractions",
    f"""WITH c AS ({TABLE_COLS}), f AS (SELECT table_id, col, CASE WHEN grid_span > 1 THEN w END AS w, count(*) OVER (PARTITION BY table_id) AS n FROM c), g AS (SELECT *, coalesce(CAST(w AS DOUBLE), 1.0 / n) AS b FROM f),
    s AS (SELECT *, sum(b) OVER (PARTITION BY table_id) AS t FROM g) SELECT table_id, col, round(b / CASE WHEN t <= 0 THEN 1.0 ELSE t END * 0.8, 7) AS fraction FROM s""",
)
def _(spark, sf):
    cols = table_cols(spark, sf).selectExpr("table_id", "col", "CASE WHEN grid_span > 1 THEN w END AS w", "0.8D AS tw")
    return T.column_fractions(cols).select("table_id", "col", F.round("fraction", 7).alias("fraction"))


@plan(
    "w21_default_grid",
    f"""WITH c AS ({TABLE_COLS}), n AS (SELECT table_id, CAST(sum(grid_span) AS INT) AS n FROM c GROUP BY 1), g AS (SELECT table_id, unnest(range(1, n + 1)) AS col FROM n)
    SELECT g.table_id, CAST(g.col AS INT) AS col, CASE WHEN w > 0 THEN w ELSE 4800 END AS w FROM g LEFT JOIN c ON c.table_id = g.table_id AND c.col = g.col""",
)
def _(spark, sf):
    cols = table_cols(spark, sf)
    needed = T.table_columns(cols.withColumn("row", F.lit(1)))
    return T.default_grid(cols.select("table_id", "col", F.col("w").cast("string").alias("w")), needed)


def _cells(spark, sf):
    return lines(spark, sf).selectExpr(
        "l_orderkey AS table_id",
        "CAST((pos - 1) DIV 3 AS INT) AS row",
        "CAST((pos - 1) % 3 AS INT) AS ord",
        "CASE WHEN l_partkey % 4 = 0 THEN CAST(l_suppkey % 3 + 1 AS INT) ELSE 1 END AS row_span",
        "CAST(l_partkey % 2 + 1 AS INT) AS col_span",
        "CAST(l_suppkey AS STRING) AS style",
        "5 AS n_cols",
    )


# A walk over the grid places of each table, one at a time: a place is covered from above, takes the next
# cell of its row, or ends the row.
_GRID_WALK = f"""WITH RECURSIVE numbered AS (SELECT *, {_POS} AS pos FROM lineitem),
cells AS (SELECT l_orderkey AS table_id, CAST((pos - 1) // 3 AS INT) AS r, CAST((pos - 1) % 3 AS INT) AS ord, CASE WHEN l_partkey % 4 = 0 THEN CAST(l_suppkey % 3 + 1 AS INT) ELSE 1 END AS tall,
  CAST(l_partkey % 2 + 1 AS INT) AS wide, CAST(l_suppkey AS VARCHAR) AS style FROM numbered),
grid_rows AS (SELECT table_id, r, row_number() OVER (PARTITION BY table_id ORDER BY r) AS k, list({{'tall': tall, 'wide': wide, 'style': style}} ORDER BY ord) AS cs FROM cells GROUP BY table_id, r),
walk AS (
  SELECT table_id, k, 1 AS i, 1 AS col, CAST([] AS STRUCT(c INT, until INT, wide INT, style VARCHAR)[]) AS above, CAST(NULL AS STRUCT(r INT, c INT, wide INT, tall INT, again BOOLEAN, style VARCHAR)) AS placed
  FROM grid_rows WHERE k = 1
  UNION ALL
  SELECT table_id, CASE WHEN step = 'row' THEN k + 1 ELSE k END, CASE step WHEN 'row' THEN 1 WHEN 'above' THEN i ELSE i + 1 END,
    CASE step WHEN 'row' THEN 1 WHEN 'above' THEN col + hit.wide WHEN 'cell' THEN col + cell.wide ELSE col END,
    CASE WHEN step = 'cell' AND cell.tall > 1 THEN list_append(list_filter(above, lambda a: a.c <> col), {{'c': col, 'until': r + cell.tall - 1, 'wide': cell.wide, 'style': cell.style}}) ELSE above END,
    CASE step WHEN 'above' THEN {{'r': r, 'c': col, 'wide': hit.wide, 'tall': 1, 'again': true, 'style': hit.style}} WHEN 'cell' THEN {{'r': r, 'c': col, 'wide': cell.wide, 'tall': cell.tall, 'again': false, 'style': cell.style}} END
  FROM (SELECT *, CASE WHEN col <= 5 AND hit IS NOT NULL THEN 'above' WHEN i > len(cs) THEN 'row' WHEN col <= 5 THEN 'cell' ELSE 'skip' END AS step
    FROM (SELECT w.*, g.r, g.cs, g.cs[i] AS cell, list_filter(w.above, lambda a: a.c = w.col AND a.until >= g.r)[1] AS hit FROM walk w JOIN grid_rows g ON w.table_id = g.table_id AND w.k = g.k)))
SELECT table_id, placed.r AS "row", placed.c AS grid_col, placed.wide AS col_span, placed.tall AS row_span, placed.again AS is_continuation, placed.style AS style FROM walk WHERE placed IS NOT NULL"""


@plan("w15_table_grid", _GRID_WALK)
def _(spark, sf):
    return T.table_grid(written(_cells(spark, sf)))


@plan(
    "p17_tables_with_cell_styles",
    "SELECT l_orderkey AS doc_id, l_suppkey % 3 AS table_pos FROM lineitem GROUP BY ALL HAVING bool_or(l_partkey % 6 = 0)",
)
def _(spark, sf):
    cells = table(spark, sf, "lineitem").selectExpr("l_orderkey AS doc_id", "l_suppkey % 3 AS table_pos", "CASE WHEN l_partkey % 6 = 0 THEN 'color: red' END AS style")
    return T.tables_with_cell_styles(cells)


@plan(
    "f37_caption_to_paragraph",
    """WITH t AS (SELECT p_partkey % 50 AS doc_id, p_partkey AS pos, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS caption FROM part)
    SELECT doc_id, pos, 0 AS sub_pos, 'para' AS kind, caption AS text FROM t WHERE caption <> '' UNION ALL SELECT doc_id, pos, 1, 'table', NULL FROM t""",
)
def _(spark, sf):
    return T.caption_to_paragraph(table(spark, sf, "part").selectExpr("p_partkey % 50 AS doc_id", "p_partkey AS pos", "CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS caption"))


# Trees as intervals: order = table, line = node inside.

def _intervals(spark, sf):
    """Each document's tables as nested intervals: block k spans to the end of the document's first half."""
    blocks = doc_blocks(spark, sf)
    outer = blocks.filter("kind = 'table'").selectExpr("doc_id", "CAST(pos * 10 AS INT) AS pos", "CAST(1000 - pos * 10 AS INT) AS close_pos", "CAST(ilvl + 1 AS INT) AS n_cols")
    inner = blocks.filter("kind <> 'table'").selectExpr("doc_id", "CAST(pos * 10 AS INT) AS pos", "heading_n")
    return inner, outer


_INTERVALS = """o AS (SELECT doc_id, pos * 10 AS pos, 1000 - pos * 10 AS close_pos, CAST(ilvl + 1 AS INT) AS n_cols FROM b WHERE kind = 'table'), i AS (SELECT doc_id, pos * 10 AS pos, heading_n FROM b WHERE kind <> 'table'),
 j AS (SELECT i.doc_id, i.pos, i.heading_n, o.pos AS outer_pos, o.close_pos AS outer_close, o.n_cols FROM i JOIN o ON i.doc_id = o.doc_id AND i.pos > o.pos AND i.pos < o.close_pos)"""


@plan("j1_contained_in", f"{BLOCKS}, {_INTERVALS} SELECT doc_id, pos, heading_n, outer_pos, outer_close, n_cols FROM j")
def _(spark, sf):
    inner, outer = _intervals(spark, sf)
    return N.contained_in(inner, outer, ["n_cols"])


@plan("j1_outside_tables", f"{BLOCKS}, {_INTERVALS} SELECT doc_id, pos, heading_n FROM i WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = i.doc_id AND i.pos > o.pos AND i.pos < o.close_pos)")
def _(spark, sf):
    inner, outer = _intervals(spark, sf)
    return N.inside_any(inner, outer, negate=True)


@plan(
    "w9_fit_images",
    f"""{BLOCKS}, {_INTERVALS}, w AS (SELECT doc_id, pos, sum(n_cols) AS c, any_value(heading_n) * 200000 AS cx, any_value(heading_n) * 90000 AS cy FROM j GROUP BY doc_id, pos)
    SELECT doc_id, pos, CAST(c AS BIGINT) AS nested_cols, CAST(CASE WHEN cx > 5943600 / c THEN floor(5943600 / c) ELSE cx END AS BIGINT) AS new_cx, CAST(CASE WHEN cx > 5943600 / c THEN floor(cy * ((5943600 / c) / cx)) ELSE cy END AS BIGINT) AS new_cy FROM w""",
)
def _(spark, sf):
    inner, outer = _intervals(spark, sf)
    images = inner.selectExpr("doc_id", "pos", "heading_n * 200000 AS cx", "heading_n * 90000 AS cy")
    return T.fit_images(images, outer, F.lit(5943600)).select("doc_id", "pos", "nested_cols", "new_cx", "new_cy")


@plan(
    "j11_parent_of",
    f"""{BLOCKS}, n AS (SELECT doc_id, pos, CAST(least(ilvl + 1, pos) AS INT) AS depth, kind AS tag FROM b)
    SELECT n.doc_id, n.pos, n.depth, n.tag, arg_max(p.tag, p.pos) AS parent_tag, max(p.pos) AS parent_at FROM n LEFT JOIN n p ON p.doc_id = n.doc_id AND p.pos < n.pos AND p.depth = n.depth - 1 GROUP BY ALL""",
)
def _(spark, sf):
    nodes = doc_blocks(spark, sf).selectExpr("doc_id", "pos", "CAST(least(ilvl + 1, pos) AS INT) AS depth", "kind AS tag")
    return N.parent_of(nodes)


@plan("f17_paragraph_style_id", f"{BLOCKS} SELECT concat_ws('__', 'FolioPara', CASE heading_n % 3 WHEN 0 THEN 'ALIGN_center' WHEN 1 THEN 'ALIGN_right' END, CASE WHEN ilvl > 0 THEN 'IND_' || CAST(ilvl * 360 AS VARCHAR) END) AS style_id, count(*) AS n FROM b GROUP BY 1")
def _(spark, sf):
    blocks = table(spark, sf, "lineitem").selectExpr("CASE (l_partkey % 12 + 1) % 3 WHEN 0 THEN 'center' WHEN 1 THEN 'right' END AS align", "CASE WHEN l_suppkey % 4 > 0 THEN l_suppkey % 4 * 360 END AS indent")
    return blocks.groupBy(paragraph_style_id(F.col("align"), F.col("indent")).alias("style_id")).agg(F.count(F.lit(1)).alias("n"))
