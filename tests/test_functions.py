"""Value tables for the column functions."""

import base64
import struct

import pytest
from pyspark.sql import functions as F

from inkshard.functions import color, css, layout, media, policy, styles
from inkshard.operators.structure import list_level
from inkshard.sources.corpus import decode_body
from inkshard.sources.dims import formats_dim, lookup_dim, output_name, paper_dim, unsupported_formats


def values(spark, inputs, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn("v").alias("r")).collect()]


def test_css_twips(spark):
    good = {"40px": 600, "12pt": 240, "0.5in": 720, "1cm": 567, "10mm": 567, "1pc": 240, "1em": 240, "2rem": 480, "40": 600, "+2px": 30, "2PX": 30}
    bad = ["0", "0px", "-40px", "50%", "auto", "calc(40px + 10px)", ".5in", "1e2px", "4 px", ""]
    assert values(spark, [*good, *bad], css.css_twips) == [*good.values(), *[None] * len(bad)]


def test_css_table_width(spark):
    cases = {"100%": ("pct", 5000), "40%": ("pct", 2000), "25%": ("pct", 1250), "150%": ("pct", 5000), "50px": ("dxa", 750), "1in": ("dxa", 1440), "auto": (None, None), "0%": (None, None), "0px": (None, None)}
    assert [tuple(r) for r in values(spark, cases, css.css_table_width)] == list(cases.values())


def test_max_width_is_not_width(spark):
    assert values(spark, ["max-width: 512px"], lambda v: css.css_value(v, "width")) == [None]


def test_declarations_first_or_last(spark):
    style = "margin-left: bad; margin-left: 30px"
    assert values(spark, [style], lambda v: css.paragraph_format(v)["twips"]) == [None]
    assert values(spark, [style], lambda v: css.css_value(v, "margin-left")) == ["30px"]


def test_half_even(spark):
    assert values(spark, ["0.5%", "0.01%", "0.03%", "0.05%"], lambda v: css.css_table_width(v)["width_value"]) == [25, None, 2, 2]


UNSAFE = [r"^^5cinput{x}", r"\makeatletter\@@input{x}", r"\def\x{\input}", r"\csname input\endcsname", r"\font\x=y", r"\input{a}"]
SAFE = ["E = mc^2", r"\frac{a}{b} + \alpha \sum_{i=1}^{n} x_i", r"\sqrt{x}", r"\begin{pmatrix} a \end{pmatrix}", r"x \text{ for all } x", r"\inputs"]


def test_unsafe_math(spark):
    assert values(spark, UNSAFE + SAFE, policy.unsafe_math) == [True] * len(UNSAFE) + [False] * len(SAFE)


def test_route_errors_in_order(spark):
    df = spark.createDataFrame([("a/b", "xls"), ("odt", "xls"), ("html", "xls"), ("html", "docx")], "s string, t string")
    got = [r[0] for r in df.select(policy.route_error("s", "t")).collect()]
    assert got == ["Format parameters must be alphanumeric", "Invalid source format: odt", "Invalid target format: xls", None]


def test_options(spark):
    allowed = policy.allowed_options("/filters")
    df = spark.createDataFrame([(["--toc", "--lua-filter=/filters/html_lists.lua", "--reference-doc=a b"],), (["--toc", "--lua-filter=/x.lua", "--bad"],), ([],)], "o array<string>")
    assert [r[0] for r in df.select(policy.bad_option("o", allowed)).collect()] == [None, "--lua-filter=/x.lua", None]


def test_size_limit():
    mb = 1024 * 1024
    assert [policy.size_limit_bytes(v) for v in ("7", 0, "-1", "x", None)] == [7 * mb, 500 * mb, 500 * mb, 500 * mb, 500 * mb]


def test_raster_sizes(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 300, 150) + b"\0" * 4
    gif = b"GIF89a" + struct.pack("<HH", 300, 150) + b"\0\0"
    bmp = b"BM" + b"\0" * 16 + struct.pack("<ii", 300, -150) + b"\0" * 4
    uri = lambda raw, kind: f"data:image/{kind};base64," + base64.b64encode(raw).decode()
    got = values(spark, [uri(png, "png"), uri(gif, "gif"), uri(bmp, "bmp"), uri(png, "svg+xml"), "media/a.png", uri(b"xx", "png")], media.raster_size)
    assert [r and tuple(r) for r in got] == [(300, 150)] * 3 + [None] * 3


def test_svg_size(spark):
    df = spark.createDataFrame([("10px", "2in", None), ("50%", "10", "0 0 30 40"), ("50%", None, None), (None, None, "0,0,1.5,2"), ("x", "4", None), ("3q", "1ex", None)], "w string, h string, vb string")
    got = [tuple(r[0]) for r in df.select(media.svg_size_px("w", "h", "vb")).collect()]
    assert got == [(10, 192, None), (15, 10, None), (None, None, "% units require a viewBox to be defined"), (2, 2, None), (None, None, None), (3, 8, None)]


def test_colors_differ_by_context(spark):
    assert values(spark, ["#abc", "rgb(1, 2,3)", "FFFFFF", "red", "auto"], color.css_hex) == ["AABBCC", "010203", "FFFFFF", None, None]
    assert values(spark, ["#aabbcc", "abc", "FFFFFF", "auto", None], color.run_hex) == ["AABBCC", None, "FFFFFF", None, None]
    assert values(spark, ["ffffff", "#aabbcc"], color.cell_hex) == [None, "AABBCC"]


def test_cascade(spark):
    chain = "array(struct('Span' AS kind, 'color:#f00;font-size:10pt;text-decoration:underline' AS style), struct('Strong' AS kind, null AS style), struct('Span' AS kind, 'font-size:150%;text-decoration:line-through;color:nope' AS style), struct('Subscript' AS kind, null AS style))"
    r = spark.sql(f"SELECT {chain} AS c").select(css.css_cascade("c").alias("p")).select("p.*").first()
    assert (r.bold, r.italic, r.underline, r.strikeout, r.fg, r.size, r.valign) == (True, None, True, True, "FF0000", 30, "subscript")
    none = "array(struct('Span' AS kind, 'text-decoration:underline' AS style), struct('Span' AS kind, 'text-decoration:none' AS style))"
    r = spark.sql(f"SELECT {none} AS c").select(css.css_cascade("c").alias("p")).select("p.*").first()
    assert (r.underline, r.strikeout) == (False, False)


def test_border(spark):
    got = values(spark, ["1.5pt solid black", "rgb(255, 0, 0) 2px", "none", "what"], css.css_border)
    assert [r and tuple(r) for r in got] == [(12, "single", "000000"), (12, "single", "FF0000"), (4, "nil", "000000"), None]


def test_marks_are_idempotent(spark):
    put = lambda t: styles.mark_merge(t, F.create_map(F.lit("bg"), F.lit("AA")))
    once = values(spark, ["x"], put)
    assert once == values(spark, once, put) == ["\ue010bg=AA\ue011x"]
    assert values(spark, once, styles.mark_strip) == ["x"]


def test_math_colors(spark):
    cases = {
        r"\color{red}{x}": r"\text{@@PMC:FF0000@@}x\text{@@PMCEND@@}",
        r"\textcolor[HTML]{00ff00}{\frac{a}{b}} c": r"\text{@@PMC:00FF00@@}\frac{a}{b}\text{@@PMCEND@@} c",
        r"\color{red} x": r"\color{red} x",
        r"\color{nocolor}{x}": "x",
        r"\textcolor{red}{\{ x": r"\textcolor{red}{\{ x",
        r"\textcolor{red}{a \} \color{#00f}{b}}": r"\text{@@PMC:FF0000@@}a \} \text{@@PMC:0000FF@@}b\text{@@PMCEND@@}\text{@@PMCEND@@}",
        r"\colorbox{red}{x}": r"\colorbox{red}{x}",
    }
    assert values(spark, cases, styles.math_color_tokens) == list(cases.values())


def test_page_size_error(spark):
    df = spark.createDataFrame([("A9",)], "p string")
    with pytest.raises(Exception, match="Unsupported paper size: A9"):
        df.select(layout.paper_dims("p")).collect()
    assert tuple(spark.createDataFrame([("letter",)], "p string").select(layout.paper_dims("p")).first()[0]) == (12240, 15840)
    with pytest.raises(Exception, match="Unsupported value: A9"):
        lookup_dim(df, paper_dim(spark), "p", "paper", strict=True).collect()


def test_formats(spark):
    dim = formats_dim(spark)
    sides = {(r.format, r.side) for r in unsupported_formats(dim.filter("is_source").select("format"), dim.filter("is_target").select("format")).collect()}
    assert {f for f, s in sides if s == "target_only"} == {"odt", "pdf", "plain", "pptx"}
    assert not [f for f, s in sides if s == "source_only"]
    assert values(spark, ["fb2", "plain", "latex"], output_name) == ["converted-document.docx", "converted-document.txt", "converted-document.tex"]


def test_decode(spark):
    df = spark.createDataFrame([(bytearray(b"a\xff"),), (bytearray("é".encode()),)], "b binary")
    assert [r[0] for r in df.select(decode_body("b")).collect()] == [None, "é"]
    assert [r[0] for r in df.select(decode_body("b", lenient=True)).collect()] == ["a�", "é"]


def test_list_level(spark):
    df = spark.createDataFrame([(None, True), ("2", True), ("-1", True), ("x", True), ("1", False)], "v string, l boolean")
    assert [r[0] for r in df.select(list_level(F.col("v"), F.col("l"))).collect()] == [0, 2, None, None, None]
