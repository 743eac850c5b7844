"""Inline CSS as column expressions: declarations, lengths, alignment, fonts, borders, cascade."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkshard.functions import constants as K
from inkshard.functions.color import css_hex, named_hex
from inkshard.functions.text import col, first, group, half_even, half_up, let, lookup, one_of, strip

_LENGTH = r"^([+-]?\d+(?:\.\d+)?)([A-Za-z%]*)$"


def declarations(style: Column | str) -> Column:
    """``k: v; k: v`` as an array of (k, v) in source order, split on the first colon."""
    parts = F.filter(F.split(col(style), ";"), lambda d: d.contains(":"))
    return F.transform(
        parts,
        lambda d: F.struct(
            F.lower(strip(F.substring_index(d, ":", 1))).alias("k"),
            strip(F.substr(d, F.instr(d, ":") + 1)).alias("v"),
        ),
    )


def css_value(style: Column | str, prop: str, policy: str = "last") -> Column:
    """Value of one property.

    ``first``: the first declaration counts even when it is unusable (paragraphs);
    ``last``: the last one, case kept (tables); ``last_lower``: the last one, lower case
    (images, inline styles).
    """
    hits = F.filter(declarations(style), lambda d: d["k"] == F.lit(prop))
    if policy == "first":
        return first(hits)["v"]
    value = F.try_element_at(hits, F.lit(-1))["v"]
    return F.lower(value) if policy == "last_lower" else value


def css_map(style: Column | str, policy: str = "last") -> Column:
    """All declarations as a map; duplicate keys are resolved by ``policy`` (see ``css_value``)."""
    def build(decls: Column) -> Column:
        def pick(k: Column) -> Column:
            hits = F.filter(decls, lambda d: d["k"] == k)
            value = first(hits)["v"] if policy == "first" else F.try_element_at(hits, F.lit(-1))["v"]
            return F.lower(value) if policy == "last_lower" else value

        keys = F.array_distinct(F.transform(decls, lambda d: d["k"]))
        return F.map_from_arrays(keys, F.transform(keys, pick))

    return let(declarations(style), build)


def css_twips(value: Column | str) -> Column:
    """Positive twips of a CSS length; null for zero, negative, percent or anything else."""
    v = col(value)
    number = group(v, _LENGTH, 1).cast("double")
    unit = F.lower(F.regexp_extract(v, _LENGTH, 2))
    twips = half_even(number * lookup(F.when(unit == "", "px").otherwise(unit), K.TWIPS_PER_UNIT)).cast("int")
    return F.when(twips > 0, twips)


def css_table_width(value: Column | str) -> Column:
    """``struct(width_type, width_value)``: percent in fiftieths, lengths in twips, else both null."""
    v = col(value)
    number = group(v, _LENGTH, 1).cast("double")
    is_pct = F.regexp_extract(v, _LENGTH, 2) == "%"
    pct = F.least(half_even(number * 50), F.lit(K.FULL_WIDTH_PCT)).cast("int")
    width = F.when(is_pct, F.when(pct > 0, pct)).otherwise(css_twips(v))
    kind = F.when(width.isNotNull(), F.when(is_pct, "pct").otherwise("dxa"))
    return F.struct(kind.alias("width_type"), width.alias("width_value"))


def css_table_align(margin_left: Column | str, margin_right: Column | str) -> Column:
    """Side an ``auto`` margin pushes a table to; null without one."""
    left = F.coalesce(F.lower(strip(col(margin_left))) == "auto", F.lit(False))
    right = F.coalesce(F.lower(strip(col(margin_right))) == "auto", F.lit(False))
    return F.when(left & right, "center").when(left, "right").when(right, "left")


def table_layout(style: Column | str) -> Column:
    """Width, justification and indent of one table from its ``style``."""
    left, right = css_value(style, "margin-left"), css_value(style, "margin-right")
    width = css_table_width(css_value(style, "width"))
    jc = css_table_align(left, right)
    return F.struct(
        width["width_type"].alias("width_type"),
        width["width_value"].alias("width_value"),
        jc.alias("jc"),
        F.when(jc == "left", css_twips(left)).alias("indent_twips"),
    )


def css_text_align(style: Column | str) -> Column:
    return lookup(F.lower(css_value(style, "text-align", "first")), K.TEXT_ALIGN)


def align_to_jc(align: Column | str) -> Column:
    return lookup(col(align), K.ALIGN_TO_JC)


def paragraph_format(style: Column | str) -> Column:
    """``struct(twips, align)`` of a paragraph's ``style``."""
    return F.struct(css_twips(css_value(style, "margin-left", "first")).alias("twips"), css_text_align(style).alias("align"))


def css_px(value: Column | str) -> Column:
    """Pixels of an absolute CSS length (image limits); null when relative, bad or not positive."""
    v = F.lower(col(value))
    number = F.regexp_extract(v, r"^(.*?)\s*([a-z%]*)$", 1).try_cast("double")
    px = number * lookup(F.regexp_extract(v, r"^(.*?)\s*([a-z%]*)$", 2), K.PX_PER_UNIT)
    return F.when(number > 0, px)


def clamp_scale(width: Column, height: Column, max_width: Column, max_height: Column) -> Column:
    """``struct(width, height)`` in px after shrinking to the limits, ratio kept, at least 1."""
    w, h = width.cast("double"), height.cast("double")
    scale = F.least(
        F.lit(1.0),
        F.when((max_width > 0) & (w > max_width), max_width / w),
        F.when((max_height > 0) & (h > max_height), max_height / h),
    )
    return F.struct(
        F.greatest(F.lit(1), half_even(w * scale)).cast("int").alias("width"),
        F.greatest(F.lit(1), half_even(h * scale)).cast("int").alias("height"),
    )


def font_half_points(value: Column | str, parent: Column | None = None) -> Column:
    """Font size in half-points; words, units, or relative to ``parent`` (default 24)."""
    v = strip(col(value))
    base = F.lit(float(K.DEFAULT_HALF_POINTS)) if parent is None else F.coalesce(parent.try_cast("double"), F.lit(float(K.DEFAULT_HALF_POINTS)))
    pattern = r"^([\d.]+)\s*([A-Za-z]+|%|)$"
    number = F.regexp_extract(v, pattern, 1).try_cast("double")
    unit = F.regexp_extract(v, pattern, 2)
    relative = F.when(unit.isin("em", "rem"), number * base).when(unit == "%", number * base / 100)
    return F.coalesce(
        lookup(v, K.FONT_SIZE_WORDS).cast("bigint"),
        F.when(v == "smaller", half_up(base * 0.83)),
        F.when(v == "larger", half_up(base * 1.2)),
        half_up(number * lookup(unit, K.HALF_POINTS_PER_UNIT)),
        half_up(relative),
    ).cast("int")


def first_font(value: Column | str) -> Column:
    """First family that is not a generic one, one pair of quotes removed."""
    names = F.transform(F.split(col(value), ","), lambda n: F.regexp_replace(strip(n), r"^['\"](.*)['\"]$", "$1"))
    return first(F.filter(names, lambda n: (n != "") & ~one_of(F.lower(n), K.GENERIC_FONTS)))


def is_bold(weight: Column | str) -> Column:
    w = col(weight)
    return F.coalesce(w.isin("bold", "bolder") | (w.try_cast("double") >= 600), F.lit(False))


def has_token(value: Column | str, token: str) -> Column:
    return F.coalesce(F.array_contains(F.split(col(value), r"[\s,]+"), token), F.lit(False))


RUN_PROPS = "struct<bold:boolean,italic:boolean,underline:boolean,strikeout:boolean,fg:string,bg:string,size:int,font:string,valign:string>"


def css_cascade(chain: Column | str) -> Column:
    """Fold an ancestor chain, outermost first, into the properties of a run.

    ``chain`` is ``array<struct<kind, style>>``; kind is Span or a formatting wrapper
    (Strong, Emph, Underline, Strikeout, Superscript, Subscript).
    """
    start = F.from_json(F.lit("{}"), RUN_PROPS)
    # Every style is parsed once; the fold itself only reads maps.
    parsed = F.transform(col(chain), lambda n: F.struct(n["kind"].alias("kind"), css_map(F.when(n["kind"] == "Span", n["style"]), "last_lower").alias("css")))

    def merge(acc: Column, node: Column) -> Column:
        val = lambda prop: F.try_element_at(node["css"], F.lit(prop))
        weight, slant = val("font-weight"), val("font-style")
        deco = F.coalesce(val("text-decoration"), val("text-decoration-line"))
        flag = lambda name, kind, new: F.when(node["kind"] == kind, F.lit(True)).otherwise(new).alias(name)
        line = lambda name, token: F.when(deco == "none", F.lit(False)).when(has_token(deco, token), F.lit(True)).otherwise(acc[name])
        given = lambda prop, value, name: F.when(val(prop).isNotNull(), F.coalesce(value, acc[name])).otherwise(acc[name]).alias(name)
        return F.struct(
            flag("bold", "Strong", F.when(weight.isNotNull(), is_bold(weight)).otherwise(acc["bold"])),
            flag("italic", "Emph", F.when(slant.isNotNull(), slant.isin("italic", "oblique")).otherwise(acc["italic"])),
            flag("underline", "Underline", line("underline", "underline")),
            flag("strikeout", "Strikeout", line("strikeout", "line-through")),
            given("color", css_hex(val("color")), "fg"),
            given("background-color", css_hex(val("background-color")), "bg"),
            given("font-size", font_half_points(val("font-size"), acc["size"]), "size"),
            given("font-family", first_font(val("font-family")), "font"),
            F.when(node["kind"].isin("Superscript", "Subscript"), F.lower(node["kind"])).otherwise(acc["valign"]).alias("valign"),
        ).cast(RUN_PROPS)

    return F.aggregate(parsed, start, merge)


def css_border(value: Column | str) -> Column:
    """``struct(sz, val, color)`` of a border shorthand in any order; null when nothing is usable."""
    is_style = lambda t: one_of(F.lower(t), K.BORDER_STYLES)
    is_size = lambda t: t.rlike(r"^[\d.]+[A-Za-z]*$")
    present = lambda arr: F.filter(arr, lambda x: x.isNotNull())

    def eighths(t: Column) -> Column:
        number = F.regexp_extract(t, r"^([\d.]+)([A-Za-z]*)$", 1).try_cast("double")
        return half_up(number * lookup(F.lower(F.regexp_extract(t, r"^([\d.]+)([A-Za-z]*)$", 2)), K.EIGHTHS_PER_UNIT))

    def sort_out(tokens: Column) -> Column:
        return F.struct(
            first(present(F.transform(F.filter(tokens, lambda t: is_size(t) & ~is_style(t)), eighths))).alias("sz"),
            lookup(F.lower(F.try_element_at(F.filter(tokens, is_style), F.lit(-1))), K.BORDER_STYLES).alias("val"),
            first(present(F.transform(F.filter(tokens, lambda t: ~is_size(t) & ~is_style(t)), lambda t: F.coalesce(css_hex(t), named_hex(t, K.BORDER_COLORS))))).alias("color"),
        )

    def fill(b: Column) -> Column:
        whole = F.struct(F.coalesce(b["sz"], F.lit(4)).cast("int").alias("sz"), F.coalesce(b["val"], F.lit("single")).alias("val"), F.coalesce(b["color"], F.lit("000000")).alias("color"))
        return F.when(F.coalesce(b["sz"].cast("string"), b["val"], b["color"]).isNotNull(), whole)

    # White space inside rgb() must not split it.
    v = F.regexp_replace(col(value), r"\s+(?=[^()]*\))", "")
    return let(let(F.filter(F.split(v, r"\s+"), lambda t: t != ""), sort_out), fill)


def border_sides(style: Column | str) -> Column:
    """Borders of the four sides; a side's own declaration beats the shorthand."""
    short = css_border(css_value(style, "border", "last_lower"))
    side = lambda s: F.coalesce(css_border(css_value(style, f"border-{s}", "last_lower")), short).alias(s)
    return F.struct(side("top"), side("left"), side("bottom"), side("right"))


def border_xml(side: str, border: Column) -> Column:
    xml = F.format_string('<w:' + side + ' w:val="%s" w:sz="%d" w:space="0" w:color="%s"/>', border["val"], border["sz"], border["color"])
    return F.when(border.isNull() | (border["val"] == "nil"), "").otherwise(xml)


def image_dim(value: Column | str) -> Column:
    """A CSS image dimension in a unit a layout can use, else null."""
    pattern = r"^\s*(\d+\.?\d*)\s*([A-Za-z%]*)\s*$"
    v = col(value)
    unit = F.regexp_extract(v, pattern, 2)
    ok = v.rlike(pattern) & unit.isin("", "px", "in", "cm", "mm", "pt", "pc", "%")
    return F.when(ok, F.concat(F.regexp_extract(v, pattern, 1), unit))


def image_dims_from_css(style: Column | str, width: Column | str, height: Column | str) -> Column:
    """Width and height attributes: kept when set, else copied from CSS."""
    w, h = F.nullif(col(width), F.lit("")), F.nullif(col(height), F.lit(""))
    return F.struct(
        F.coalesce(w, image_dim(css_value(style, "width", "last_lower"))).alias("width"),
        F.coalesce(h, image_dim(css_value(style, "height", "last_lower"))).alias("height"),
    )


def cell_align(style: Column | str, align: Column | str, column_align: Column | str) -> Column:
    """``struct(v_align, jc)`` of a cell; its own alignment beats the column's."""
    jc = lambda c: F.when(c.isin("left", "center", "right"), c)
    own = F.nullif(F.lower(col(align)), F.lit("default"))
    return F.struct(
        lookup(css_value(style, "vertical-align", "last_lower"), {"top": "top", "middle": "center", "bottom": "bottom"}).alias("v_align"),
        F.when(own.isNotNull(), jc(own)).otherwise(jc(F.lower(col(column_align)))).alias("jc"),
    )


def twips_guard(value: Column | str) -> Column:
    """A whole number of twips between 0 and 31680, else null."""
    n = col(value).try_cast("double")
    return F.when(n.between(0, K.MAX_INDENT_TWIPS) & (n == F.floor(n)), n.cast("int"))


def line_fraction(value: Column | str) -> Column:
    """A CSS table width as a share of the text line, at most 1."""
    pattern = r"^\s*([\d.]+)\s*([A-Za-z]*%?)\s*$"
    v = col(value)
    number = F.regexp_extract(v, pattern, 1).try_cast("double")
    unit = F.regexp_extract(v, pattern, 2)
    share = F.when(unit == "%", number / 100).otherwise(number * lookup(unit, K.POINTS_PER_UNIT) / K.LINE_POINTS)
    return F.when((number > 0) & share.isNotNull(), F.least(share, F.lit(1.0)))
