"""Queries over node trees of small HTML documents built from part."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkshard.functions.media import data_url, raster_size, svg_img_width, svg_size_px, svg_source
from inkshard.functions.styles import ooxml_run
from inkshard.operators import nodes as N
from inkshard.plans.registry import plan, table
from inkshard.plans.views import pages, parts
from inkshard.session import written
from inkshard.sources.html import html_nodes

GIF = "data:image/gif;base64,R0lGODlhLAGWAAAA"

_HTML = f"""concat('<div>',
 CASE p_partkey % 4 WHEN 0 THEN '<ol><ol><li>a</li></ol></ol>' WHEN 1 THEN '<ol><li>x<ul><li>y</li></ul></li></ol>' WHEN 2 THEN '<ul><li>a</li><ul><li>b</li></ul></ul>' ELSE '<ul><li>z</li></ul>' END,
 CASE p_partkey % 3 WHEN 0 THEN concat('<p style="margin-left: ', p_size, 'px; text-align: center; margin-left: 9px">t</p>') WHEN 1 THEN '<p style="color: red">t</p>' ELSE '<p>t' END,
 '<img src="{GIF}" style="max-width: ', p_size * 10, 'px"', CASE WHEN p_partkey % 5 = 0 THEN ' width="7"' ELSE '' END, '>',
 CASE WHEN p_partkey % 2 = 0 THEN '<p><b>Fig <span class="note rte-caption" data-sequence="Figure">1</span></b></p>' ELSE '' END,
 '<span style="color: #f00; font-size: 10pt"><b>b<span style="font-size: 2em; text-decoration: underline">big</span></b></span>',
 CASE WHEN p_partkey % 6 = 0 THEN '<svg width="10" height="20"><svg></svg></svg>' ELSE '' END,
 '</div>')"""


def _docs(spark, sf):
    return parts(spark, sf, "p_size").selectExpr("p_partkey AS doc_id", f"{_HTML} AS html")


def _nodes(spark, sf):
    return html_nodes(_docs(spark, sf))


@plan("w4_orphan_lists", "SELECT p_partkey AS doc_id, CASE p_partkey % 4 WHEN 0 THEN 'ol' ELSE 'ul' END AS tag, CASE p_partkey % 4 WHEN 0 THEN 'ol' ELSE 'ul' END AS parent_tag FROM part WHERE p_partkey % 4 IN (0, 2)")
def _(spark, sf):
    return N.orphan_lists(_nodes(spark, sf)).select("doc_id", "tag", "parent_tag")


@plan("w4_wrap_orphan_lists", "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 4 = 3 THEN 1 ELSE 2 END + CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 0 END AS n_items, CASE WHEN p_partkey % 4 IN (0, 2) THEN 1 ELSE 0 END AS n_suppressed FROM (SELECT p_partkey FROM part WHERE p_partkey % 4 <> 2) UNION ALL SELECT p_partkey, 3, 1 FROM part WHERE p_partkey % 4 = 2")
def _(spark, sf):
    wrapped = N.wrap_orphan_lists(_nodes(spark, sf)).filter("tag = 'li'")
    return wrapped.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.count_if("marker_suppressed").alias("n_suppressed"))


@plan("p12_formatted_paragraphs", "SELECT p_partkey AS doc_id, CASE WHEN p_size > 0 THEN p_size * 15 END AS twips, 'center' AS align FROM part WHERE p_partkey % 3 = 0")
def _(spark, sf):
    return N.formatted_paragraphs(_nodes(spark, sf)).select("doc_id", "twips", "align")


@plan("p16_markup_passthrough", "SELECT p_partkey AS doc_id, p_partkey % 3 = 0 AS changed FROM part")
def _(spark, sf):
    nodes = _nodes(spark, sf)
    return N.markup_passthrough(table(spark, sf, "part").selectExpr("p_partkey AS doc_id"), N.formatted_paragraphs(nodes))


_FIT = "least(1.0, CASE WHEN p_size > 0 AND p_size * 10 < 300 THEN p_size * 10 / 300.0 END)"


@plan("p13_sizeable_images", f"SELECT p_partkey AS doc_id, CAST(greatest(1, round_even(300 * {_FIT}, 0)) AS INT) AS width_px, CAST(greatest(1, round_even(150 * {_FIT}, 0)) AS INT) AS height_px FROM part WHERE p_partkey % 5 <> 0")
def _(spark, sf):
    return N.sizeable_images(_nodes(spark, sf)).select("doc_id", "width_px", "height_px")


@plan("p11_is_caption", "SELECT p_partkey AS doc_id, 'p' AS tag FROM part WHERE p_partkey % 2 = 0")
def _(spark, sf):
    nodes = written(_nodes(spark, sf))
    return N.is_caption(nodes.filter("tag = 'p'"), nodes).select("doc_id", "tag")


@plan(
    "f15_css_cascade",
    "SELECT p_partkey AS doc_id, 'b' AS text, true AS bold, CAST(NULL AS BOOLEAN) AS underline, 'FF0000' AS fg, 20 AS size FROM part UNION ALL SELECT p_partkey, 'big', true, true, 'FF0000', 40 FROM part",
)
def _(spark, sf):
    styled = N.styled_runs(_docs(spark, sf)).filter("tag IN ('b', 'span') AND text IN ('b', 'big')")
    return styled.select("doc_id", "text", "props.bold", "props.underline", "props.fg", "props.size")


@plan("f15_bold_runs_of_pages", "SELECT page_id AS doc_id, CAST(sum(len(regexp_extract_all(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '<b>[^<]'))) AS BIGINT) AS n_bold FROM pages GROUP BY 1")
def _(spark, sf):
    runs = N.styled_runs(pages(spark, sf)).filter("tag = 'b' AND props.bold")
    return pages(spark, sf).select("doc_id").join(runs, "doc_id", "left").groupBy("doc_id").agg(F.count("text").alias("n_bold"))


_SVG = '<svg width="10" height="20"><svg></svg></svg>'


@plan("f10_inline_svg_to_img", f"SELECT p_partkey AS doc_id, 'data:image/svg+xml;base64,' || base64(encode('{_SVG}')) AS src, '10' AS width, '20' AS height FROM part WHERE p_partkey % 6 = 0")
def _(spark, sf):
    return N.top_level_svgs(_docs(spark, sf)).drop("pos")


@plan(
    "x1_user_rewrite",
    """SELECT p_partkey AS doc_id, 'strong' AS tag, 'B' AS text FROM part UNION ALL SELECT p_partkey, 'strong', 'FIG ' FROM part WHERE p_partkey % 2 = 0
    UNION ALL SELECT p_partkey, 'img', '' FROM part UNION ALL SELECT p_partkey, 'span', 'big' FROM part UNION ALL SELECT p_partkey, 'span', '1' FROM part WHERE p_partkey % 2 = 0""",
)
def _(spark, sf):
    tag = F.col("tag")
    changed = N.rewrite(_nodes(spark, sf), (tag == "b", {"tag": F.lit("strong")}), (tag == "strong", {"text": F.upper("text")}), (tag == "li", lambda rows: rows.filter("false")))
    return changed.filter(tag.isin("strong", "img", "li") | ((tag == "span") & (F.col("text") != ""))).select("doc_id", "tag", "text")


_TREE_NODES = """SELECT r_regionkey AS doc_id, 0 AS pos, CAST(NULL AS BIGINT) AS parent_pos, 0 AS depth, 'r' AS tag, r_regionkey AS own FROM region
UNION ALL SELECT n_regionkey, 1 + n_nationkey, 0, 1, 'n', n_nationkey FROM nation
UNION ALL SELECT n_regionkey, 1000 + c_custkey, 1 + n_nationkey, 2, 'c', c_custkey % 7 FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT n_regionkey, 1000000000000 + o_orderkey, 1000 + c_custkey, 3, 'o', o_orderkey % 13 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


def _tree(spark, sf):
    """A document for each region: nations, customers and orders inside each other, as nodes."""
    views = {t: table(spark, sf, t) for t in ("region", "nation", "customer", "orders")}
    sql = _TREE_NODES
    for t in views:
        sql = sql.replace(f" {t}", f" {{{t}}}")
    return spark.sql(sql, **views).select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("parent_pos").cast("bigint").alias("parent_pos"), "depth", "tag", F.col("own").cast("bigint").alias("own"))


# From the deepest level up: a level's values from those below it.
_UP = "".join(
    f""", u{d} AS (SELECT t.*, (own + 3 * coalesce(s, 0) + coalesce(m, 0)) % 1009 AS value, coalesce(k, 0) AS n_children FROM t
  LEFT JOIN (SELECT doc_id, parent_pos, sum(value) AS s, max(value) AS m, count(*) AS k FROM {f"u{d + 1}" if d < 3 else "(SELECT *, own AS value FROM t WHERE false)"} GROUP BY ALL) c ON t.doc_id = c.doc_id AND t.pos = c.parent_pos WHERE depth = {d})"""
    for d in (3, 2, 1, 0)
)


@plan("x1_rewrite_up", f"WITH t AS ({_TREE_NODES}){_UP} " + " UNION ALL ".join(f"SELECT doc_id, pos, depth, CAST(value AS BIGINT) AS value, n_children FROM u{d}" for d in range(4)))
def _(spark, sf):
    value = (F.col("own") + 3 * F.coalesce("s", F.lit(0)) + F.coalesce("m", F.lit(0))) % 1009
    gather = {"s": F.sum("value"), "m": F.max("value"), "k": F.count(F.lit(1))}
    nodes = _tree(spark, sf).withColumn("value", F.lit(0).cast("bigint"))
    return N.rewrite_up(nodes, gather, {"value": value, "n_children": F.coalesce("k", F.lit(0))}).select("doc_id", "pos", "depth", "value", "n_children")


_DOWN = "".join(
    f""", d{d} AS (SELECT t.*, {"'r' AS path, own AS value FROM t" if d == 0 else f"p.path || '>' || t.tag AS path, (31 * p.value + t.own) % 1009 AS value FROM t JOIN d{d - 1} p ON t.doc_id = p.doc_id AND t.parent_pos = p.pos"} WHERE t.depth = {d})"""
    for d in range(4)
)


@plan("x1_rewrite_down", f"WITH t AS ({_TREE_NODES}){_DOWN} " + " UNION ALL ".join(f"SELECT doc_id, pos, path, CAST(value AS BIGINT) AS value FROM d{d}" for d in range(4)))
def _(spark, sf):
    path = F.concat_ws(">", "above", "tag")
    value = F.when(F.col("v").isNull(), F.col("own")).otherwise((31 * F.col("v") + F.col("own")) % 1009)
    nodes = _tree(spark, sf).withColumns({"path": F.lit(None).cast("string"), "value": F.lit(None).cast("bigint")})
    return N.rewrite_down(nodes, {"above": F.col("path"), "v": F.col("value")}, {"path": path, "value": value}).select("doc_id", "pos", "path", "value")


# Pages with markup of their own kind put on elements they have: every plain <p> gets a style and a caption span, every
# <br> an image and a drawing in mixed case, every navigation list a list around it.
_STYLED_P = "<p style=\"margin-left: 40px; text-align: right\"><span class=\"x rte-caption\">c</span>"
_DRAWN = f"<br><img src=\"{GIF}\"><SVG width=\"10\" height=\"20\"><g><svg></svg></g></SVG>"
_RICH = f"replace(replace(replace(html, '<p>', '{_STYLED_P}'), '<br>', '{_DRAWN}'), '<nav><ul>', '<nav><ul><ul>')"
# What of a page the parser reads as markup.
_READ = "regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g')"


def _rich_pages(spark, sf):
    return pages(spark, sf).selectExpr("doc_id", f"{_RICH} AS html")


def _rich_nodes(spark, sf):
    return html_nodes(_rich_pages(spark, sf))


def _count_of(markup):
    """Rows of a page with that markup, as many as it has."""
    return f"(SELECT page_id AS doc_id, unnest(range(len(regexp_extract_all({_READ}, '{markup}')))) FROM pages)"


@plan("p11_is_caption_of_pages", f"SELECT doc_id, 'p' AS tag FROM {_count_of('<p>')}")
def _(spark, sf):
    nodes = written(_rich_nodes(spark, sf))
    return N.is_caption(nodes.filter("tag = 'p'"), nodes).select("doc_id", "tag")


@plan("p12_formatted_paragraphs_of_pages", f"SELECT doc_id, 600 AS twips, 'right' AS align FROM {_count_of('<p>')}")
def _(spark, sf):
    return N.formatted_paragraphs(_rich_nodes(spark, sf)).select("doc_id", "twips", "align")


@plan("p13_sizeable_images_of_pages", f"SELECT doc_id, 300 AS width_px, 150 AS height_px FROM {_count_of('<br>')}")
def _(spark, sf):
    return N.sizeable_images(_rich_nodes(spark, sf)).select("doc_id", "width_px", "height_px")


@plan("p16_markup_passthrough_of_pages", f"SELECT page_id AS doc_id, contains({_READ}, '<br>') AS changed FROM pages")
def _(spark, sf):
    return N.markup_passthrough(pages(spark, sf), N.sizeable_images(_rich_nodes(spark, sf)))


@plan("w4_orphan_lists_of_pages", f"SELECT doc_id, 'ul' AS tag, 'ul' AS parent_tag FROM {_count_of('<nav><ul>')}")
def _(spark, sf):
    return N.orphan_lists(_rich_nodes(spark, sf)).select("doc_id", "tag", "parent_tag")


_DRAWING = '<SVG width="10" height="20"><g><svg></svg></g></SVG>'


@plan("f10_inline_svg_to_img_of_pages", f"SELECT doc_id, 'data:image/svg+xml;base64,' || base64(encode('{_DRAWING}')) AS src, '10' AS width, '20' AS height FROM {_count_of('<br>')}")
def _(spark, sf):
    return N.top_level_svgs(_rich_pages(spark, sf)).drop("pos")


@plan("f7_raster_size", "SELECT p_partkey AS doc_id, p_size + 1 AS width, p_partkey % 65536 AS height FROM part")
def _(spark, sf):
    le = lambda c: F.unhex(F.concat(F.substring(F.lpad(F.hex(c), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(c), 4, "0"), 1, 2)))
    raw = F.concat(F.unhex(F.lit("474946383961")), le((F.col("p_size") + 1).cast("bigint")), le(F.col("p_partkey") % 65536), F.unhex(F.lit("0000")))
    size = raster_size(F.concat(F.lit("data:image/gif;base64,"), F.base64(raw)))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), size.alias("s")).select("doc_id", "s.*")


@plan("f8_svg_size_px", """SELECT p_partkey AS doc_id, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN CAST(ceil(p_size * (4 / 3)) AS INT) WHEN 2 THEN CAST(ceil(p_size / 100 * 33.5) AS INT) ELSE NULL END AS width,
    CASE p_partkey % 4 WHEN 3 THEN NULL ELSE 13 END AS height, CASE p_partkey % 4 WHEN 3 THEN '% units require a viewBox to be defined' END AS error FROM part""")
def _(spark, sf):
    parts = table(spark, sf, "part").selectExpr(
        "p_partkey AS doc_id", "concat(p_size, CASE p_partkey % 4 WHEN 0 THEN 'px' WHEN 1 THEN 'pt' ELSE '%' END) AS w", "CASE WHEN p_partkey % 4 < 3 THEN '0,0 33.5  12.2' END AS vb"
    )
    return parts.select("doc_id", svg_size_px("w", F.lit(None).cast("string"), "vb").alias("s")).select("doc_id", "s.*")


@plan("f9_data_url", """SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CASE p_partkey % 3 WHEN 1 THEN 'image/png' ELSE 'text/plain' END END AS content_type,
    CASE WHEN p_partkey % 3 = 2 THEN p_name END AS svg FROM part""")
def _(spark, sf):
    src = F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'media/a.png' ELSE concat('data:', CASE p_partkey % 3 WHEN 1 THEN 'image/png' ELSE 'text/plain' END, ';base64,', base64(encode(p_name, 'UTF-8'))) END")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), data_url(src)["content_type"].alias("content_type"), svg_source(src).alias("svg"))


@plan("f41_svg_img_width", "SELECT p_partkey AS doc_id, 'color: red; width: ' || p_size || 'px' AS style FROM part")
def _(spark, sf):
    style = F.expr("concat('color: red; WIDTH: ', p_partkey, 'px;; height:', p_size, 'em ')")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), svg_img_width(style, F.col("p_size")).alias("style"))


@plan(
    "f32_ooxml_run",
    """SELECT p_partkey AS doc_id, '<w:r><w:rPr>' || CASE WHEN p_partkey % 2 = 0 THEN '<w:b/>' ELSE '' END || '<w:color w:val="FF0000"/><w:sz w:val="' || p_size || '"/><w:szCs w:val="' || p_size || '"/>'
    || CASE WHEN p_partkey % 3 = 0 THEN '<w:u w:val="single"/>' ELSE '' END || '</w:rPr><w:t xml:space="preserve">' || p_name || '</w:t></w:r>' AS xml FROM part""",
)
def _(spark, sf):
    none = F.lit(None).cast("string")
    props = F.struct(
        (F.col("p_partkey") % 2 == 0).alias("bold"),
        F.lit(False).alias("italic"),
        (F.col("p_partkey") % 3 == 0).alias("underline"),
        F.lit(None).cast("boolean").alias("strikeout"),
        F.lit("FF0000").alias("fg"),
        none.alias("bg"),
        F.col("p_size").alias("size"),
        none.alias("font"),
        none.alias("valign"),
    )
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), ooxml_run(props, F.col("p_name")).alias("xml"))
