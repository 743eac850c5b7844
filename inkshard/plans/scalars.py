"""Queries that run one column function over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkshard.functions import color as C
from inkshard.functions import constants as K
from inkshard.functions import css
from inkshard.functions import layout as Y
from inkshard.functions import styles as S
from inkshard.plans.registry import plan, table
from inkshard.plans.views import RAW_RUNS, STYLED_TABLES, raw_runs, styled_tables

_P = "p_partkey AS id"


def _part(spark, sf, *exprs):
    return table(spark, sf, "part").selectExpr(_P, *exprs)


def _line(spark, sf, *exprs):
    return table(spark, sf, "lineitem").selectExpr("l_orderkey AS id", *exprs)


_DUP = "concat(' Width : ', CAST(p_size AS STRING), 'PX ; bad; color:#F00; width:', CAST(p_size + 1 AS STRING), 'Pt;a:b:c')"


@plan("f1_css_map", "SELECT p_partkey AS id, p_size || 'PX' AS first_w, (p_size + 1) || 'Pt' AS last_w, (p_size + 1) || 'pt' AS low_w, 'b:c' AS a, 3 AS n FROM part")
def _(spark, sf):
    rows = _part(spark, sf, f"{_DUP} AS style")
    w = lambda policy: css.css_map("style", policy)["width"]
    return rows.select("id", w("first").alias("first_w"), w("last").alias("last_w"), w("last_lower").alias("low_w"), css.css_map("style")["a"].alias("a"), F.size(css.css_map("style")).alias("n"))


_UNITS = ["px", "pt", "in", "cm", "mm", "pc", "em", "%", "", "vw"]
_LENGTH = "concat(CAST((p_partkey % 97 - 5) / 4 AS DECIMAL(8, 2)), CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN '{u}'" for i, u in enumerate(_UNITS)) + " END)"
_FACTOR = "CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN {K.TWIPS_PER_UNIT.get(u or 'px', 'NULL')}" for i, u in enumerate(_UNITS)) + " END"


@plan("f2_css_twips", f"WITH t AS (SELECT p_partkey AS id, CAST(round_even(CAST(CAST((p_partkey % 97 - 5) / 4 AS DECIMAL(8, 2)) AS DOUBLE) * {_FACTOR}, 0) AS INT) AS twips FROM part) SELECT id, CASE WHEN twips > 0 THEN twips END AS twips FROM t")
def _(spark, sf):
    return _part(spark, sf, f"{_LENGTH} AS v").select("id", css.css_twips("v").alias("twips"))


@plan(
    "f3_css_table_width",
    f"""WITH t AS (SELECT p_partkey AS id, p_partkey % 10 AS u, CAST(CAST((p_partkey % 97 - 5) / 4 AS DECIMAL(8, 2)) AS DOUBLE) AS n, {_FACTOR} AS f FROM part),
    w AS (SELECT id, u, CAST(CASE WHEN u = 7 THEN least(round_even(n * 50, 0), 5000) ELSE round_even(n * f, 0) END AS INT) AS v FROM t)
    SELECT id, CASE WHEN v > 0 THEN CASE WHEN u = 7 THEN 'pct' ELSE 'dxa' END END AS width_type, CASE WHEN v > 0 THEN v END AS width_value FROM w""",
)
def _(spark, sf):
    return _part(spark, sf, f"{_LENGTH} AS v").select("id", css.css_table_width("v").alias("w")).select("id", "w.*")


@plan("f4_css_table_align", f"WITH s AS ({STYLED_TABLES}) SELECT table_id AS id, CASE table_id % 4 WHEN 0 THEN 'center' WHEN 3 THEN 'right' WHEN 2 THEN 'left' END AS jc FROM s")
def _(spark, sf):
    s = styled_tables(spark, sf)
    return s.select(F.col("table_id").alias("id"), css.css_table_align(css.css_value("style", "margin-left"), css.css_value("style", "margin-right")).alias("jc"))


_ALIGNS = ["Left", "center", "RIGHT", "justify", "start", "end", "inherit"]
_ALIGN = "concat('text-align: ', CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(_ALIGNS)) + " END, '; text-align: left')"


@plan("f5_css_text_align", "SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN 'left' WHEN 1 THEN 'center' WHEN 2 THEN 'right' WHEN 3 THEN 'justify' WHEN 4 THEN 'left' WHEN 5 THEN 'right' END AS align, CASE p_partkey % 7 WHEN 0 THEN 'left' WHEN 1 THEN 'center' WHEN 2 THEN 'right' WHEN 3 THEN 'both' WHEN 4 THEN 'left' WHEN 5 THEN 'right' END AS jc FROM part")
def _(spark, sf):
    align = css.css_text_align("style")
    return _part(spark, sf, f"{_ALIGN} AS style").select("id", align.alias("align"), css.align_to_jc(align).alias("jc"))


@plan(
    "f6_clamp_scale",
    """WITH t AS (SELECT p_partkey AS id, p_partkey % 900 + 1 AS w, p_size * 20 + 1 AS h, CASE WHEN p_partkey % 3 = 0 THEN 200.0 END AS mw, CASE WHEN p_partkey % 4 = 0 THEN 96.0 END AS mh FROM part),
    s AS (SELECT *, least(1.0, CASE WHEN w > mw THEN mw / w END, CASE WHEN h > mh THEN mh / h END) AS k FROM t)
    SELECT id, CAST(greatest(1, round_even(w * k, 0)) AS INT) AS width, CAST(greatest(1, round_even(h * k, 0)) AS INT) AS height FROM s""",
)
def _(spark, sf):
    rows = _part(spark, sf, "p_partkey % 900 + 1 AS w", "p_size * 20 + 1 AS h", "CASE WHEN p_partkey % 3 = 0 THEN '200px' ELSE '50%' END AS mw", "CASE WHEN p_partkey % 4 = 0 THEN '1in' END AS mh")
    return rows.select("id", css.clamp_scale(F.col("w"), F.col("h"), css.css_px("mw"), css.css_px("mh")).alias("s")).select("id", "s.*")


@plan("f11_hex_color_run_cell", f"WITH r AS ({RAW_RUNS}) SELECT color, fill, CASE WHEN color IN ('ff0000', '#FF0000') THEN 'FF0000' END AS run_hex, fill AS run_fill, nullif(fill, 'FFFFFF') AS cell_hex, count(*) AS n FROM r GROUP BY ALL")
def _(spark, sf):
    return raw_runs(spark, sf).groupBy("color", "fill", C.run_hex("color").alias("run_hex"), C.run_hex("fill").alias("run_fill"), C.cell_hex("fill").alias("cell_hex")).agg(F.count(F.lit(1)).alias("n"))


@plan(
    "f11_hex_color_css",
    """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN printf('%02X%02X%02X', p_size, p_partkey % 256, 7) WHEN 1 THEN upper(printf('%06x', p_partkey % 16777216)) WHEN 2 THEN 'AABBCC' END AS css_hex,
    CASE p_partkey % 4 WHEN 0 THEN printf('%02X%02X%02X', p_size, p_partkey % 256, 7) WHEN 1 THEN upper(printf('%06x', p_partkey % 16777216)) WHEN 2 THEN 'AABBCC' ELSE '000000' END AS border_hex FROM part""",
)
def _(spark, sf):
    v = "CASE p_partkey % 4 WHEN 0 THEN concat('rgb( ', p_size, ' , ', p_partkey % 256, ',7)') WHEN 1 THEN concat('#', lpad(lower(hex(p_partkey % 16777216)), 6, '0')) WHEN 2 THEN ' #aBc' ELSE 'WindowText' END AS v"
    return _part(spark, sf, v).select("id", C.css_hex("v").alias("css_hex"), C.border_hex("v").alias("border_hex"))


@plan(
    "f11_hex_color_math",
    """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'FFA500' WHEN 1 THEN '112233' WHEN 2 THEN NULL WHEN 3 THEN 'AABBCC' WHEN 4 THEN NULL ELSE 'AABBCC' END AS math_hex FROM part""",
)
def _(spark, sf):
    v = "CASE p_partkey % 6 WHEN 0 THEN 'Orange' WHEN 1 THEN '#123' WHEN 2 THEN 'mauve' WHEN 3 THEN 'aabbcc' WHEN 4 THEN 'red' ELSE 'aabbcc' END AS v"
    return _part(spark, sf, v, "CASE p_partkey % 6 WHEN 3 THEN 'html' WHEN 4 THEN 'HTML' ELSE '' END AS model").select("id", C.math_hex("model", "v").alias("math_hex"))


@plan(
    "f12_font_half_points",
    """SELECT p_partkey AS id, CAST(CASE p_partkey % 8 WHEN 0 THEN 48 WHEN 1 THEN floor(p_size * 0.83 + 0.5) WHEN 2 THEN floor(p_size * 1.5 + 0.5) WHEN 3 THEN p_size * 2 WHEN 4 THEN floor(p_size * p_size / 100 + 0.5)
     WHEN 5 THEN floor(1.25 * p_size + 0.5) WHEN 6 THEN floor(56.6929134 * p_size + 0.5) END AS INT) AS hp FROM part""",
)
def _(spark, sf):
    v = "CASE p_partkey % 8 WHEN 0 THEN 'xx-large' WHEN 1 THEN 'smaller' WHEN 2 THEN concat(p_size, 'px') WHEN 3 THEN concat(' ', p_size, ' ') WHEN 4 THEN concat(p_size, ' %') WHEN 5 THEN '1.25em' WHEN 6 THEN concat(p_size, 'cm') ELSE 'calc(1em)' END AS v"
    return _part(spark, sf, v, "p_size").select("id", css.font_half_points("v", F.col("p_size")).alias("hp"))


@plan("f13_first_font", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'Segoe UI' WHEN 1 THEN p_brand END AS font FROM part")
def _(spark, sf):
    v = "CASE p_partkey % 3 WHEN 0 THEN concat('''Segoe UI'', ', p_brand) WHEN 1 THEN concat('Sans-Serif , ', p_brand, ', serif') ELSE 'serif,monospace' END AS v"
    return _part(spark, sf, v).select("id", css.first_font("v").alias("font"))


@plan("f14_is_bold_has_token", "SELECT p_partkey AS id, p_size * 20 >= 600 AS bold, p_partkey % 2 = 0 AS underline FROM part")
def _(spark, sf):
    rows = _part(spark, sf, "CAST(p_size * 20 AS STRING) AS w", "CASE WHEN p_partkey % 2 = 0 THEN 'line-through, underline' ELSE 'underlined blink' END AS d")
    return rows.select("id", css.is_bold("w").alias("bold"), css.has_token("d", "underline").alias("underline"))


@plan(
    "f16_css_border",
    """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN CAST(floor(p_size * 6 + 0.5) AS INT) WHEN 1 THEN 12 WHEN 2 THEN 4 END AS sz, CASE p_partkey % 4 WHEN 0 THEN 'dashed' WHEN 1 THEN 'single' WHEN 2 THEN 'nil' END AS val,
    CASE p_partkey % 4 WHEN 0 THEN 'FF0007' WHEN 1 THEN '000080' WHEN 2 THEN '000000' END AS color FROM part""",
)
def _(spark, sf):
    v = "CASE p_partkey % 4 WHEN 0 THEN concat(p_size, 'px dashed rgb(255, 0, 7)') WHEN 1 THEN 'navy GROOVE 1.5pt' WHEN 2 THEN 'none' ELSE 'weird' END AS v"
    return _part(spark, sf, v).select("id", css.css_border("v").alias("b")).select("id", "b.*")


@plan("f16_border_sides", """SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN '<w:top w:val="double" w:sz="16" w:space="0" w:color="FF0000"/>' ELSE '<w:top w:val="single" w:sz="' || p_size * 8 || '" w:space="0" w:color="000000"/>' END AS top,
    '<w:left w:val="single" w:sz="' || p_size * 8 || '" w:space="0" w:color="000000"/>' AS "left" FROM part""")
def _(spark, sf):
    rows = _part(spark, sf, "concat('border: ', p_size, 'pt solid', CASE WHEN p_partkey % 2 = 0 THEN '; border-top: double red 2pt' ELSE '' END) AS style").withColumn("s", css.border_sides("style"))
    return rows.select("id", css.border_xml("top", F.col("s.top")).alias("top"), css.border_xml("left", F.col("s.left")).alias("left"))


@plan("f17_style_id", f"""WITH r AS ({RAW_RUNS}) SELECT concat_ws('__', 'FolioColor', 'FG_' || CASE WHEN color IN ('ff0000', '#FF0000') THEN 'FF0000' END, 'BG_' || fill, 'HL_' || highlight, 'SZ_' || CASE WHEN sz <> '0' THEN sz END,
    'SZCS_' || CASE WHEN is_space THEN '8' END) AS style_id, count(*) AS n FROM (SELECT * REPLACE (CASE WHEN is_space AND sz = '8' THEN false ELSE is_space END AS is_space) FROM r) GROUP BY 1""")
def _(spark, sf):
    sid = S.style_id(C.run_hex("color"), C.run_hex("fill"), F.col("highlight"), S.half_points("sz"), F.when(F.col("is_space"), "8"))
    return raw_runs(spark, sf).groupBy(sid.alias("style_id")).agg(F.count(F.lit(1)).alias("n"))


@plan("f18_parse_style_id", f"""WITH r AS ({RAW_RUNS}), s AS (SELECT CASE WHEN color IN ('ff0000', '#FF0000') THEN 'FF0000' END AS fg, fill AS bg, highlight AS hl, CASE WHEN sz <> '0' THEN sz END AS sz FROM r) SELECT fg, bg, hl, sz, count(*) AS n FROM s GROUP BY ALL""")
def _(spark, sf):
    none = F.lit(None).cast("string")
    sid = S.style_id(C.run_hex("color"), C.run_hex("fill"), F.col("highlight"), S.half_points("sz"), none)
    # The id is a column of its own, so that it is built once and not once per part read from it.
    parsed = raw_runs(spark, sf).select(sid.alias("sid")).select(S.parse_style_id("sid").alias("p")).select("p.*")
    return parsed.groupBy("fg", "bg", "hl", "sz").agg(F.count(F.lit(1)).alias("n"))


@plan("f19_marks", """SELECT p_partkey AS id, chr(57360) || CASE WHEN p_partkey % 2 = 0 THEN 'tw=0.5;bg=AABBCC' ELSE 'bg=AABBCC' END || chr(57361) || p_name AS merged, p_name AS rest, CASE WHEN p_partkey % 2 = 0 THEN '0.5' END AS tw, p_name AS stripped FROM part""")
def _(spark, sf):
    rows = _part(spark, sf, "p_name", "p_partkey % 2 = 0 AS even")
    text = F.when(F.col("even"), F.concat(S.mark_encode(F.create_map(F.lit("tw"), F.lit("0.5"), F.lit("bg"), F.lit("000000"))), F.col("p_name"))).otherwise(F.col("p_name"))
    merged = rows.withColumn("merged", S.mark_merge(text, F.create_map(F.lit("bg"), F.lit("AABBCC"))))
    parsed = S.mark_parse("merged")
    noisy = F.concat(F.col("merged"), S.level_mark(F.lit(3)))
    return merged.select("id", "merged", parsed["rest"].alias("rest"), F.try_element_at(parsed["props"], F.lit("tw")).alias("tw"), S.mark_strip(noisy).alias("stripped"))


@plan(
    "f20_table_line_fraction",
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 < 2 AND p_partkey % 12000 > 0 THEN printf('%.4f', least(1.0, p_partkey % 12000 / CASE p_partkey % 3 WHEN 0 THEN 5000.0 ELSE 9360.0 END)) END AS tw, p_partkey % 3 = 1 AND p_partkey % 12000 > 0 AS absolute,
    CASE p_partkey % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'center' END AS ta FROM part""",
)
def _(spark, sf):
    rows = _part(spark, sf, "CASE p_partkey % 3 WHEN 0 THEN 'pct' WHEN 1 THEN 'dxa' ELSE 'auto' END AS t", "CAST(p_partkey % 12000 AS STRING) AS w", "CASE p_partkey % 4 WHEN 0 THEN 'start' WHEN 1 THEN 'end' WHEN 2 THEN 'Center' ELSE 'both' END AS jc")
    return rows.select("id", Y.table_line_fraction("t", "w", "jc").alias("f")).select("id", "f.*")


@plan(
    "f20_html_line_fraction",
    """SELECT p_partkey AS id, CASE WHEN p_size > 0 AND p_partkey % 4 < 3 THEN round(least(1.0, CASE p_partkey % 4 WHEN 0 THEN p_size / 100.0 WHEN 1 THEN p_size * 0.75 / 468 WHEN 2 THEN p_size * 28.3465 / 468 END), 9) END AS share FROM part""",
)
def _(spark, sf):
    rows = _part(spark, sf, "concat(p_size, CASE p_partkey % 4 WHEN 0 THEN '%' WHEN 1 THEN '' WHEN 2 THEN 'cm' ELSE 'em' END) AS v")
    return rows.select("id", F.round(css.line_fraction("v"), 9).alias("share"))


@plan("f21_math_color_tokens", r"SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '\text{@@PMC:FF0000@@}\frac{a}{' || p_size || '}\text{@@PMC:00FF00@@}x\text{@@PMCEND@@}\text{@@PMCEND@@}' WHEN 1 THEN '\color{red} ' || p_size WHEN 2 THEN 'y' || p_size ELSE '\textcolor{red}{a' END AS tex FROM part")
def _(spark, sf):
    v = r"CASE p_partkey % 4 WHEN 0 THEN concat('\\textcolor{red} {\\frac{a}{', p_size, '}\\color[HTML]{00ff00}{x}}') WHEN 1 THEN concat('\\color{red} ', p_size) WHEN 2 THEN concat('\\textcolor{nocolor}{y', p_size, '}') ELSE '\\textcolor{red}{a' END AS v"
    return _part(spark, sf, v).select("id", S.math_color_tokens("v").alias("tex"))


@plan("f23_seq_name", "SELECT l_orderkey AS id, CASE WHEN l_partkey % 3 < 2 THEN 'Tab' || l_suppkey % 4 END AS seq FROM lineitem")
def _(spark, sf):
    rows = _line(spark, sf, "CASE l_partkey % 3 WHEN 0 THEN concat(' SEQ  Tab', l_suppkey % 4, ' \\\\* ARABIC ') WHEN 1 THEN concat('SEQ Tab', l_suppkey % 4) ELSE 'PAGEREF x' END AS i")
    return rows.select("id", S.seq_name("i").alias("seq"))


@plan(
    "f25_page_size",
    """WITH t AS (SELECT p_partkey AS id, p_partkey % 3 AS p, p_partkey // 3 % 3 AS o, p_partkey % 5 = 0 AS none, p_partkey % 2 = 0 AS land FROM part),
    a AS (SELECT *, CASE WHEN p = 0 THEN CASE WHEN none THEN NULL WHEN land THEN 900 ELSE 500 END WHEN o = 0 AND land THEN CASE p WHEN 1 THEN 16838 ELSE 15840 END ELSE CASE p WHEN 1 THEN 11906 ELSE 12240 END END AS w1,
      CASE WHEN p = 0 THEN CASE WHEN none THEN NULL WHEN land THEN 500 ELSE 900 END WHEN o = 0 AND land THEN CASE p WHEN 1 THEN 11906 ELSE 12240 END ELSE CASE p WHEN 1 THEN 16838 ELSE 15840 END END AS h1 FROM t),
    b AS (SELECT *, coalesce(w1, 12240) AS w2, coalesce(h1, 15840) AS h2 FROM a)
    SELECT id, CASE WHEN o = 0 THEN w1 WHEN (w2 > h2) <> (o = 1) THEN h2 ELSE w2 END AS w, CASE WHEN o = 0 THEN h1 WHEN (w2 > h2) <> (o = 1) THEN w2 ELSE h2 END AS h,
    CASE WHEN o = 0 THEN CASE WHEN land THEN 'landscape' END WHEN o = 1 THEN 'landscape' END AS orient FROM b""",
)
def _(spark, sf):
    rows = _part(
        spark, sf,
        "CASE p_partkey % 3 WHEN 1 THEN 'a4' WHEN 2 THEN 'Letter' END AS paper",
        "CASE p_partkey DIV 3 % 3 WHEN 1 THEN 'Landscape' WHEN 2 THEN 'upright' END AS o",
        "CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 900 ELSE 500 END AS w",
        "CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 500 ELSE 900 END AS h",
        "CASE WHEN p_partkey % 2 = 0 THEN 'landscape' END AS orient",
    )
    return rows.select("id", Y.page_size("paper", "o", "w", "h", "orient").alias("s")).select("id", "s.*")


@plan("f26_slide_size", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 9144000 WHEN 1 THEN 12188952 WHEN 2 THEN 9905695 END AS w, CASE p_partkey % 4 WHEN 0 THEN 5148072 WHEN 1 THEN 6858000 WHEN 2 THEN 6858000 END AS h FROM part")
def _(spark, sf):
    return _part(spark, sf, "CASE p_partkey % 4 WHEN 0 THEN '16:9' WHEN 1 THEN 'Widescreen' WHEN 2 THEN 'a4' END AS s").select("id", Y.slide_size("s").alias("d")).select("id", "d.*")


@plan("f27_clamp_twips", "SELECT p_partkey AS id, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 7 ELSE least(p_partkey * 7, 5943600 // 635) END AS BIGINT) AS clamped FROM part")
def _(spark, sf):
    rows = _part(spark, sf, "p_partkey * 7 AS w", "CASE WHEN p_partkey % 3 = 0 THEN -7 END AS page")
    emu = F.when(F.col("page").isNull(), Y.content_width_emu(F.col("page"), F.lit(None).cast("int"), F.lit(0))).otherwise(F.col("page"))
    return rows.select("id", Y.clamp_twips(F.col("w"), emu).alias("clamped"))


@plan(
    "f30_latex_run",
    r"""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN '{\fontsize{5.5}{6.6}\selectfont ' ELSE '' END || '\textcolor[HTML]{FF0000}{' || CASE p_partkey % 3 WHEN 0 THEN '{\setlength{\fboxsep}{0pt}\colorbox[HTML]{00FFFF}{\strut{}' || p_name || '}}' ELSE p_name END
    || '}' || CASE WHEN p_partkey % 2 = 0 THEN '}' ELSE '' END AS tex FROM part""",
)
def _(spark, sf):
    rows = _part(spark, sf, "p_name", "p_partkey")
    props = F.struct(
        F.lit("FF0000").alias("fg"),
        F.when(F.col("p_partkey") % 3 == 1, "FFFFFF").alias("bg"),
        F.lit("cyan").alias("hl"),
        F.when(F.col("p_partkey") % 2 == 0, "11").otherwise("x").alias("sz"),
    )
    kinds = F.when(F.col("p_partkey") % 3 == 2, F.array(F.lit("Str"), F.lit("Link"))).otherwise(F.array(F.lit("Str")))
    return rows.select("id", S.latex_run(props, F.col("p_name"), S.boxable("p_name", kinds)).alias("tex"))


@plan("p15_boxable", "SELECT doc_id AS id, octet_length(encode(text)) <= 60 AND doc_id % 2 = 0 AS boxable FROM documents")
def _(spark, sf):
    kinds = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("Str"), F.lit("Emph"))).otherwise(F.array(F.lit("Note")))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), S.boxable("text", kinds).alias("boxable"))


@plan(
    "f31_latex_paragraph_glue",
    r"""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 OR p_size > 0 THEN '{' || printf('\leftskip=%.2fpt ', p_size * 30 / 20) || CASE WHEN p_partkey % 3 = 0 THEN '\centering ' ELSE '' END || p_name || '\par}' ELSE p_name END AS tex,
    CASE WHEN p_partkey % 2 = 0 THEN '\setlength{\tabcolsep}{3pt}' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN '\setlength{\LTleft}{0pt}\setlength{\LTright}{\fill}' ELSE '' END AS before,
    CASE WHEN p_partkey % 2 = 0 THEN '\setlength{\tabcolsep}{6pt}' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN '\setlength{\LTleft}{\fill}\setlength{\LTright}{\fill}' ELSE '' END AS after FROM part""",
)
def _(spark, sf):
    rows = _part(spark, sf, "p_name", "p_partkey", "p_size")
    style = S.paragraph_style_id(F.when(F.col("p_partkey") % 3 == 0, "center"), F.col("p_size") * 30)
    glue = S.latex_table_glue(F.when(F.col("p_partkey") % 3 == 0, "left"), F.col("p_partkey") % 2 == 0)
    return rows.select("id", S.latex_paragraph(style, F.col("p_name")).alias("tex"), glue["before"].alias("before"), glue["after"].alias("after"))


@plan(
    "f33_fields",
    """SELECT p_partkey AS id, ' SEQ ' || CASE WHEN p_partkey % 2 = 0 THEN 'Figure' ELSE 'Table' END || ' \\* ARABIC ' AS seq, ' TC "' || p_name || '" \\f ' || CASE WHEN p_partkey % 2 = 0 THEN 'F' ELSE 'T' END || ' \\l "1" ' AS tc,
    ' TOC \\h \\z \\f ' || CASE WHEN p_partkey % 2 = 0 THEN 'F' ELSE 'T' END || ' ' AS listing, ' PAGEREF _Toc' || p_partkey || ' \\h ' AS page FROM part""",
)
def _(spark, sf):
    even = F.col("p_partkey") % 2 == 0
    rows = _part(spark, sf, "p_name", "p_partkey")
    return rows.select(
        "id",
        S.seq_field(F.when(even, "Figure").otherwise("Table")).alias("seq"),
        S.tc_field(F.col("p_name"), F.when(even, "figure").otherwise("table")).alias("tc"),
        S.listing_field(F.when(even, "tof").otherwise("tot")).alias("listing"),
        S.page_ref_field(F.concat(F.lit("_Toc"), F.col("p_partkey").cast("string"))).alias("page"),
    )


@plan("f36_twips_guard", "SELECT l_orderkey AS id, CASE l_partkey % 4 WHEN 0 THEN CASE WHEN l_suppkey * 100 <= 31680 THEN CAST(l_suppkey * 100 AS INT) END WHEN 1 THEN 600 END AS twips FROM lineitem")
def _(spark, sf):
    rows = _line(spark, sf, "CASE l_partkey % 4 WHEN 0 THEN CAST(l_suppkey * 100 AS STRING) WHEN 1 THEN '600' WHEN 2 THEN '600.5' ELSE '-3' END AS v")
    return rows.select("id", css.twips_guard("v").alias("twips"))


@plan("f39_image_dims_from_css", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '7' WHEN 1 THEN p_size || 'px' END AS width, p_size || '%' AS height FROM part")
def _(spark, sf):
    rows = _part(spark, sf, "concat('WIDTH: ', p_size, CASE p_partkey % 3 WHEN 2 THEN 'vw' ELSE ' PX' END, '; height:', p_size, '%') AS style", "CASE p_partkey % 3 WHEN 0 THEN '7' ELSE '' END AS w")
    return rows.select("id", css.image_dims_from_css("style", "w", F.lit(None).cast("string")).alias("d")).select("id", "d.*")


@plan("f40_cell_align", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'center' WHEN 1 THEN 'top' END AS v_align, CASE p_partkey % 2 WHEN 0 THEN 'right' ELSE 'left' END AS jc FROM part")
def _(spark, sf):
    rows = _part(spark, sf, "CASE p_partkey % 3 WHEN 0 THEN 'vertical-align: Middle' WHEN 1 THEN 'vertical-align:top' ELSE 'vertical-align: baseline' END AS style", "CASE p_partkey % 2 WHEN 0 THEN 'right' ELSE 'default' END AS a")
    return rows.select("id", css.cell_align("style", "a", F.lit("left")).alias("c")).select("id", "c.*")


@plan("o4_schema_order", "SELECT p_partkey AS id, CASE p_partkey % 2 WHEN 0 THEN 'tblStyle,tblW,jc,tblLayout' ELSE 'tblW,tblInd,tblLook,custom' END AS ordered FROM part")
def _(spark, sf):
    rows = _part(spark, sf, "CASE p_partkey % 2 WHEN 0 THEN array('jc', 'tblLayout', 'tblStyle', 'tblW') ELSE array('custom', 'tblLook', 'tblW', 'tblInd') END AS p")
    return rows.select("id", F.array_join(S.schema_order("p"), ",").alias("ordered"))
