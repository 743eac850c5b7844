"""Queries over pages, documents and conversations."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from inkshard.functions.policy import has_color_macro, has_svg, unsafe_math
from inkshard.functions import constants as K
from inkshard.functions.styles import math_markers_to_tex
from inkshard.functions.text import escape_xml
from inkshard.operators import joins as J
from inkshard.operators.render import render_blocks, render_pages
from inkshard.plans.registry import plan, table
from inkshard.plans.views import MATH_SPANS, math_spans, pages
from inkshard.session import shared_dir
from inkshard.sources.ast_json import read_ast_json, write_ast_json
from inkshard.sources.corpus import decode_body, read_corpus, read_pages, write_rendered
from inkshard.sources.files import read_documents, write_documents
from inkshard.sources.html import html_nodes, html_tokens, register_html_nodes

# Tokens told apart on their own terms: no possessive parts, whole elements first, quoted values by alternation.
_SQL_TOKEN = r"""(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|</?[a-z](?:"[^"]*"|''[^'']*''|[^>"''])*>|<![^>]*>|[^<]+|<[^<]*"""
_TOKENS = f"""t AS (SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '{_SQL_TOKEN}')) AS tok, generate_subscripts(regexp_extract_all(html, '{_SQL_TOKEN}'), 1) - 1 AS pos FROM pages),
 n AS (SELECT *, CASE WHEN right(tok, 1) = '>' THEN nullif(lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9]*)', 1)), '') END AS tag FROM t),
 k AS (SELECT *, CASE WHEN left(tok, 4) = '<!--' THEN 'comment' WHEN left(tok, 2) = '<!' THEN 'doctype' WHEN tag IS NULL THEN 'text' WHEN left(tok, 2) = '</' THEN 'close' WHEN tag IN ('script', 'style') THEN tag ELSE 'open' END AS kind FROM n)"""


@plan("s1_read_corpus", "SELECT page_id AS doc_id, html FROM pages")
def _(spark, sf):
    return read_pages(spark, f"{sf}/pages.parquet")


@plan("s1_read_corpus_files", "SELECT page_id AS doc_id, html, md5(html) AS md5, CAST(strlen(html) AS BIGINT) AS n_bytes FROM pages WHERE html <> ''")
def _(spark, sf):
    """Pages written as files, one each, and read back twice: as text, and as bytes as packages are."""
    folder = f"{shared_dir(spark)}/{uuid4().hex}"
    write_documents(pages(spark, sf).select("doc_id", F.lit(0).alias("part"), F.col("html").alias("text"), F.lit("html").alias("target_format")), folder)
    doc_id = F.url_decode(F.url_decode(F.element_at(F.split("path", "/"), -3))).cast("bigint").alias("doc_id")
    texts, blobs = (read_corpus(spark, folder, f, nested=True).select(doc_id, "body") for f in ("html", "docx"))
    sizes = blobs.select("doc_id", F.md5("body").alias("md5"), F.octet_length("body").cast("bigint").alias("n_bytes"))
    return texts.withColumnRenamed("body", "html").join(sizes, "doc_id")


@plan("s2_decode_body", "SELECT doc_id, text AS strict, text AS guarded, text AS lenient FROM documents")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("body"))
    return docs.select("doc_id", decode_body("body", "UTF-8").alias("strict"), decode_body("body").alias("guarded"), decode_body("body", lenient=True).alias("lenient"))


@plan("s3_html_tokens", f"WITH {_TOKENS} SELECT doc_id, CAST(pos AS INT) AS pos, tok, kind, tag FROM k")
def _(spark, sf):
    return html_tokens(pages(spark, sf))


@plan("s4_html_nodes", f"WITH {_TOKENS} SELECT doc_id, tag, count(*) AS n FROM k WHERE kind IN ('open', 'script', 'style') GROUP BY ALL")
def _(spark, sf):
    return html_nodes(pages(spark, sf)).groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@plan("s4_html_tree")
def _(spark, sf):
    attrs = F.array_join(F.array_sort(F.transform(F.map_entries("attrs"), lambda a: F.concat_ws("=", a["key"], a["value"]))), " ")
    return html_nodes(pages(spark, sf)).withColumn("attrs", attrs)


@plan(
    "a19_markup_profile",
    f"""WITH {_TOKENS} SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (kind = 'open' AND tag = 'p') AS n_p, count(*) FILTER (kind = 'open' AND tag = 'li') AS n_li, count(*) FILTER (kind = 'open' AND tag = 'table') AS n_table,
    count(*) FILTER (kind = 'open' AND tag = 'img') AS n_img, count(*) FILTER (kind = 'open' AND tag = 'svg') AS n_svg, count(*) FILTER (kind = 'script' AND contains(tok, 'math/tex')) AS n_math,
    count(*) FILTER (kind = 'open' AND tag = 'p') - count(*) FILTER (kind = 'close' AND tag = 'p') AS n_unclosed_p FROM k GROUP BY 1""",
)
def _(spark, sf):
    return J.markup_profile(html_tokens(pages(spark, sf)))


@plan("a19_tag_documents", f"WITH {_TOKENS} SELECT tag, count(DISTINCT doc_id) AS n_docs, CAST(count(*) AS BIGINT) AS n_uses FROM k WHERE kind = 'open' GROUP BY 1")
def _(spark, sf):
    return J.tag_documents(html_tokens(pages(spark, sf)))


# Rendering.  The sample pages have no ordered lists; block by block in SQL:
# cut at block tags, clean the text, drop empty blocks, join.

_BLOCK_TAGS = "address|article|aside|blockquote|body|center|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"


def _render_sql(dialect: str) -> str:
    bold = {"plain": r"\1", "markdown": r"**\1**", "textile": r"*\1*", "html": "\x06\\1\x07"}[dialect]
    level = "CAST(substr(tag, 2) AS INT)"
    head = "regexp_matches(tag, '^h[1-6]$')"
    safe = "replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '\x06', '<strong>'), '\x07', '</strong>')"
    block = {
        "plain": "CASE WHEN tag = 'li' THEN '-   ' || text ELSE text END",
        "markdown": f"CASE WHEN tag = 'li' THEN '-   ' || text WHEN {head} THEN repeat('#', {level}) || ' ' || text ELSE text END",
        "textile": f"CASE WHEN tag = 'li' THEN '* ' || text WHEN {head} THEN tag || '(#' || replace(lower(replace(text, '*', '')), ' ', '-') || '). ' || text ELSE text END",
        "html": f"CASE WHEN tag = 'li' THEN '<li>' || {safe} || '</li>' WHEN {head} THEN '<' || tag || '>' || {safe} || '</' || tag || '>' ELSE '<p>' || {safe} || '</p>' END",
    }[dialect]
    steps = [
        (r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>|<!doctype[^>]*>", ""),
        (rf"(?i)<(/?)({_BLOCK_TAGS})\b[^>]*>", "\x01\\1\\2\x02"),
        (r"(?i)<(?:b|strong)\b[^>]*>([^" + "\x01" + r"]*?)</(?:b|strong)>", bold),
        (r"(?i)<br\b[^>]*>", "\x03"),
        (r"<[^>]*>", ""),
        (r"[ \t\r\n\f]+", " "),
        (" ?\x03 ?", "\n"),
    ]
    expr = "html"
    for pattern, to in steps:
        expr = f"regexp_replace({expr}, '{pattern}', '{to}', 'g')"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", chr(34)), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        expr = f"replace({expr}, '{name}', '{char}')"
    return f"""WITH f AS (SELECT page_id AS doc_id, string_split({expr}, '\x01') AS segs FROM pages),
    s AS (SELECT doc_id, unnest(segs) AS seg, generate_subscripts(segs, 1) AS pos FROM f),
    b AS (SELECT doc_id, pos, CASE WHEN contains(seg, '\x02') THEN lower(split_part(seg, '\x02', 1)) ELSE '' END AS tag, trim(CASE WHEN contains(seg, '\x02') THEN split_part(seg, '\x02', 2) ELSE seg END, ' \n') AS text FROM s),
    n AS (SELECT *, lag(tag) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM b WHERE text <> '')
    SELECT doc_id, CAST(0 AS BIGINT) AS part, string_agg(CASE WHEN before IS NULL THEN '' WHEN before = 'li' AND tag = 'li' THEN '\n' ELSE '\n\n' END || {block}, '' ORDER BY pos) AS text, count(*) AS n_blocks FROM n GROUP BY 1"""


@plan("a13_render_plain", _render_sql("plain"))
def _(spark, sf):
    return render_pages(pages(spark, sf), "plain")


@plan("a13_render_markdown", _render_sql("markdown"))
def _(spark, sf):
    return render_pages(pages(spark, sf), "markdown")


@plan("a13_render_textile", _render_sql("textile"))
def _(spark, sf):
    return render_pages(pages(spark, sf), "textile")


@plan("a13_render_html", _render_sql("html"))
def _(spark, sf):
    return render_pages(pages(spark, sf), "html")


# Conversations: a turn is a block; the first one of each is a heading, user turns are list items.
_TURN_KIND = "CASE WHEN turn = 0 THEN 'header' WHEN role = 'user' THEN 'ordered' ELSE 'para' END"


@plan(
    "a13_render_conversations",
    f"""WITH b AS (SELECT conv_id AS doc_id, turn, {_TURN_KIND} AS kind, trim(text) AS text, turn AS number FROM conversations),
    n AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY turn) AS before FROM b WHERE text <> '')
    SELECT doc_id, CAST(0 AS BIGINT) AS part, string_agg(CASE WHEN before IS NULL THEN '' WHEN before = 'ordered' AND kind = 'ordered' THEN '\n' ELSE '\n\n' END ||
      CASE kind WHEN 'header' THEN '# ' || text WHEN 'ordered' THEN number || '.  ' || text ELSE text END, '' ORDER BY turn) AS text, count(*) AS n_blocks FROM n GROUP BY 1""",
)
def _(spark, sf):
    blocks = table(spark, sf, "conversations").selectExpr("conv_id AS doc_id", "turn AS pos", f"{_TURN_KIND} AS kind", "1 AS level", "CAST(turn AS INT) AS number", "trim(text) AS text")
    return render_blocks(blocks, "markdown")


@plan(
    "s7_rendered_files",
    f"""WITH p AS (FROM ({_render_sql("plain")})), m AS (FROM ({_render_sql("markdown")})), r AS (SELECT *, 'plain' AS target_format FROM p UNION ALL SELECT *, 'markdown' FROM m UNION ALL SELECT *, 'fb2' FROM p)
    SELECT doc_id, target_format, 'converted-document.' || CASE target_format WHEN 'plain' THEN 'txt' WHEN 'markdown' THEN 'md' ELSE 'docx' END AS file_name,
    CASE target_format WHEN 'markdown' THEN 'text/markdown' ELSE 'application/octet-stream' END AS mime_type, text FROM r""",
)
def _(spark, sf):
    """Rendered, written one folder for each target, and read back."""
    docs = pages(spark, sf)
    # Each dialect once, then a row for each of its targets.
    plain, markdown = (render_pages(docs, d).withColumn("target_format", F.explode(F.array(*map(F.lit, targets)))) for d, targets in (("plain", ["plain", "fb2"]), ("markdown", ["markdown"])))
    folder = f"{shared_dir(spark)}/{uuid4().hex}"
    write_rendered(plain.unionByName(markdown), folder)
    return spark.read.parquet(folder).select("doc_id", F.col("target_format").cast("string").alias("target_format"), "file_name", "mime_type", "text")


@plan(
    "s7_document_files",
    f"""WITH p AS (FROM ({_render_sql("plain")})), m AS (FROM ({_render_sql("markdown")})), r AS (SELECT *, 'plain' AS target_format, 'txt' AS e FROM p UNION ALL SELECT *, 'markdown', 'md' FROM m)
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, target_format, 'converted-document.' || e AS file_name, text FROM r WHERE text <> ''""",
)
def _(spark, sf):
    """Rendered, one file written for each page and target, and read back from the files."""
    docs = pages(spark, sf)
    plain, markdown = (render_pages(docs, d).withColumn("target_format", F.lit(d)) for d in ("plain", "markdown"))
    folder = f"{shared_dir(spark)}/{uuid4().hex}"
    write_documents(plain.unionByName(markdown), folder)
    return read_documents(spark, folder)


@plan(
    "s11_write_ast_json",
    """WITH b AS (SELECT conv_id, turn, role, text FROM conversations)
    SELECT conv_id AS doc_id, CAST(0 AS BIGINT) AS part, '[' || string_agg('{"kind":"' || role || '","level":' || turn || ',"text":' || CAST(to_json(text) AS VARCHAR) || '}', ',' ORDER BY turn) || ']' AS json FROM b GROUP BY 1""",
)
def _(spark, sf):
    return write_ast_json(_turn_blocks(spark, sf))


def _turn_blocks(spark, sf):
    return table(spark, sf, "conversations").selectExpr("conv_id AS doc_id", "turn AS pos", "role AS kind", "CAST(turn AS INT) AS level", "text")


@plan("s11_read_ast_json", "SELECT conv_id AS doc_id, CAST(0 AS BIGINT) AS part, CAST(turn AS INT) AS pos, role AS kind, CAST(turn AS INT) AS level, text FROM conversations")
def _(spark, sf):
    return read_ast_json(write_ast_json(_turn_blocks(spark, sf)))


@plan("x4_html_nodes_in_sql", f"WITH {_TOKENS} SELECT doc_id, tag, count(*) AS n FROM k WHERE kind IN ('open', 'script', 'style') GROUP BY ALL")
def _(spark, sf):
    register_html_nodes(spark)
    return spark.sql("SELECT p.doc_id, n.tag, count(*) AS n FROM {docs} p, LATERAL html_nodes(p.html) n GROUP BY p.doc_id, n.tag", docs=pages(spark, sf))


# Content policies.

_DENY = "(" + ", ".join(f"'{w}'" for w in K.DENIED_TEX) + ")"


@plan(
    "p5_unsafe_math",
    rf"""WITH m AS ({MATH_SPANS}) SELECT doc_id, tex, len(list_filter(regexp_extract_all(tex, '\\([A-Za-z]+)', 1), lambda x: x IN {_DENY})) > 0 OR contains(tex, '@') OR contains(tex, '^^') AS unsafe FROM m""",
)
def _(spark, sf):
    return math_spans(spark, sf).select("doc_id", "tex", unsafe_math("tex").alias("unsafe"))


@plan("p6_has_svg", "SELECT page_id AS doc_id, contains(lower(html), '<svg') OR contains(lower(html), 'data:image/svg+xml') AS svg FROM pages")
def _(spark, sf):
    return pages(spark, sf).select("doc_id", has_svg("html").alias("svg"))


@plan("p7_has_color_macro", r"SELECT doc_id, contains(text || CASE WHEN doc_id % 3 = 0 THEN ' \textcolor{red}{x}' ELSE '' END, '\color') OR contains(text || CASE WHEN doc_id % 3 = 0 THEN ' \textcolor{red}{x}' ELSE '' END, '\textcolor') AS colored FROM documents")
def _(spark, sf):
    text = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " \\textcolor{red}{x}").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", has_color_macro(text).alias("colored"))


@plan("f29_xml_escape", "SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", escape_xml("text").alias("escaped"))


@plan("f22_math_markers_to_tex", r"SELECT doc_id, substr(text, 1) || ' {\color[HTML]{00FF00} ' || replace(lang, chr(10), ' ') || '}' AS tex FROM documents")
def _(spark, sf):
    marked = F.concat(F.col("text"), F.lit(" PMCzzz00FF00zzz"), F.col("lang"), F.lit("zzzPMCENDzzz"))
    return table(spark, sf, "documents").select("doc_id", math_markers_to_tex(marked).alias("tex"))
