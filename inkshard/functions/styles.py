"""Style ids, carried property marks, and the markup written for runs, paragraphs and tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkshard.functions import constants as K
from inkshard.functions.text import col, escape_xml, let, lookup

# The prefixes are parameters: pass the ones your documents already use.
RUN_PREFIX = "FolioColor"
PARAGRAPH_PREFIX = "FolioPara"


def half_points(value: Column | str) -> Column:
    """A run size as a bare positive integer string, else null."""
    n = col(value).try_cast("int")
    return F.when(n > 0, n.cast("string"))


def _segment(key: str, value: Column) -> Column:
    return F.concat(F.lit(key + "_"), value)


def style_id(fg: Column, bg: Column, highlight: Column, size: Column, size_cs: Column, prefix: str = RUN_PREFIX) -> Column:
    """Id of a run style; absent parts are left out, the complex-script size only when it differs."""
    cs = F.when(~size_cs.eqNullSafe(size), size_cs)
    return F.concat_ws("__", F.lit(prefix), _segment("FG", fg), _segment("BG", bg), _segment("HL", F.nullif(highlight, F.lit(""))), _segment("SZ", size), _segment("SZCS", cs))


def paragraph_style_id(align: Column, indent: Column, prefix: str = PARAGRAPH_PREFIX) -> Column:
    return F.concat_ws("__", F.lit(prefix), _segment("ALIGN", align), _segment("IND", indent.cast("string")))


def parse_style_id(name: Column | str, prefix: str = RUN_PREFIX) -> Column:
    """Run properties read back from a style id; colours must be six hex digits."""
    n = col(name)
    part = lambda key, shape: F.nullif(F.regexp_extract(n, f"__{key}_({shape})(?=__|_|$)", 1), F.lit(""))
    hex6, any_value = "[0-9A-Fa-f]{6}", "[^_]+"
    props = F.struct(part("FG", hex6).alias("fg"), part("BG", hex6).alias("bg"), part("HL", any_value).alias("hl"), part("SZ", any_value).alias("sz"))
    return F.when(n.startswith(prefix), props)


# Marks: a property map in front of a text, ``<open>k=v;k=v<close>text``.


def mark_encode(props: Column | str) -> Column:
    pairs = F.transform(F.map_entries(col(props)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.concat(F.lit(K.PROPS_OPEN), F.array_join(pairs, ";"), F.lit(K.PROPS_CLOSE))


def mark_parse(text: Column | str) -> Column:
    """``struct(props, rest)``; a text without a complete mark at its start has no properties."""
    t = col(text)
    pattern = f"(?s)^{K.PROPS_OPEN}([^{K.PROPS_CLOSE}]*){K.PROPS_CLOSE}(.*)$"
    has = t.rlike(pattern)
    segments = F.filter(F.split(F.regexp_extract(t, pattern, 1), ";"), lambda s: s.contains("="))
    entries = F.transform(segments, lambda s: F.struct(F.substring_index(s, "=", 1).alias("key"), F.substr(s, F.instr(s, "=") + 1).alias("value")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = lambda k: F.try_element_at(F.filter(entries, lambda e: e["key"] == k), F.lit(-1))["value"]
    props = F.map_from_arrays(keys, F.transform(keys, last))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.struct(F.when(has, props).otherwise(empty).alias("props"), F.when(has, F.regexp_extract(t, pattern, 2)).otherwise(t).alias("rest"))


def mark_merge(text: Column | str, props: Column | str) -> Column:
    """Add properties to a text's mark: new values win, other keys stay; a mark is made if there is none."""
    new = col(props)

    def merge(parsed: Column) -> Column:
        old = parsed["props"]
        kept = F.transform(F.map_keys(old), lambda k: F.concat_ws("=", k, F.coalesce(F.try_element_at(new, k), F.try_element_at(old, k))))
        added = F.transform(F.filter(F.map_entries(new), lambda e: ~F.map_contains_key(old, e["key"])), lambda e: F.concat_ws("=", e["key"], e["value"]))
        return F.concat(F.lit(K.PROPS_OPEN), F.array_join(F.concat(kept, added), ";"), F.lit(K.PROPS_CLOSE), parsed["rest"])

    return let(mark_parse(text), merge)


def mark_strip(text: Column | str) -> Column:
    """Remove every mark, property and level marks alike."""
    return F.regexp_replace(
        F.regexp_replace(col(text), f"{K.PROPS_OPEN}[^{K.PROPS_CLOSE}]*{K.PROPS_CLOSE}", ""), f"{K.LEVEL_OPEN}\\d+{K.LEVEL_CLOSE}", ""
    )


def level_mark(level: Column | str) -> Column:
    return F.concat(F.lit(K.LEVEL_OPEN), col(level).cast("string"), F.lit(K.LEVEL_CLOSE))


# Written markup.


def boxable(text: Column | str, kinds: Column | str) -> Column:
    """A run short and plain enough for an unbreakable colour box; length counts bytes."""
    return (F.octet_length(col(text)) <= K.MAX_BOXED_BYTES) & ~F.arrays_overlap(col(kinds), F.array(*[F.lit(k) for k in K.UNBOXABLE]))


def _plain_number(x: Column) -> Column:
    """Six significant digits at most, no trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), r"0+$", ""), r"\.$", "")


def latex_run(props: Column, text: Column, can_box: Column) -> Column:
    """A run in TeX: size outside, colour inside it, box innermost; fill beats highlight, white is none."""
    fill = F.coalesce(props["bg"], lookup(props["hl"], K.HIGHLIGHT_HEX))
    fill = F.when((F.upper(fill) != "FFFFFF") & can_box, fill)
    hp = props["sz"].try_cast("double")
    size = F.when((hp > 0) & (hp == F.floor(hp)), F.concat(F.lit("{\\fontsize{"), _plain_number(hp / 2), F.lit("}{"), _plain_number(hp / 2 * 1.2), F.lit("}\\selectfont ")))
    color = F.concat(F.lit("\\textcolor[HTML]{"), props["fg"], F.lit("}{"))
    box = F.concat(F.lit("{\\setlength{\\fboxsep}{0pt}\\colorbox[HTML]{"), fill, F.lit("}{\\strut{}"))
    close = F.concat(
        F.when(box.isNotNull(), "}}").otherwise(""), F.when(color.isNotNull(), "}").otherwise(""), F.when(size.isNotNull(), "}").otherwise("")
    )
    return F.concat(F.concat_ws("", size, color, box), text, close)


def latex_paragraph(style: Column | str, text: Column, prefix: str = PARAGRAPH_PREFIX) -> Column:
    """A paragraph in TeX with the indent and alignment its style id carries."""
    s = col(style)
    align = lookup(F.lower(F.regexp_extract(s, "__ALIGN_([^_]+)", 1)), {"left": "\\raggedright", "center": "\\centering", "right": "\\raggedleft"})
    twips = F.regexp_extract(s, "__IND_([^_]+)", 1).try_cast("double")
    ok = twips.between(0, K.MAX_INDENT_TWIPS) & (twips == F.floor(twips))
    indent = F.when(ok, F.format_string("\\leftskip=%.2fpt ", twips / 20))
    wrapped = F.concat(F.lit("{"), F.coalesce(indent, F.lit("")), F.coalesce(F.concat(align, F.lit(" ")), F.lit("")), text, F.lit("\\par}"))
    return F.when(s.startswith(prefix) & (align.isNotNull() | indent.isNotNull()), wrapped).otherwise(text)


_GLUE = {
    "left": "\\setlength{\\LTleft}{0pt}\\setlength{\\LTright}{\\fill}",
    "center": "\\setlength{\\LTleft}{\\fill}\\setlength{\\LTright}{\\fill}",
    "right": "\\setlength{\\LTleft}{\\fill}\\setlength{\\LTright}{0pt}",
}


def latex_table_glue(align: Column | str, absolute: Column) -> Column:
    """``struct(before, after)`` around a table: padding for absolute widths, glue for its side."""
    glue = lookup(col(align), _GLUE)
    narrow = F.coalesce(absolute, F.lit(False))
    before = F.concat_ws("", F.when(narrow, "\\setlength{\\tabcolsep}{3pt}"), glue)
    after = F.concat_ws("", F.when(narrow, "\\setlength{\\tabcolsep}{6pt}"), F.when(glue.isNotNull(), _GLUE["center"]))
    return F.struct(before.alias("before"), after.alias("after"))


def ooxml_run(props: Column, text: Column) -> Column:
    """A run element; property children follow the schema order."""
    tag = lambda cond, xml: F.when(F.coalesce(cond, F.lit(False)), xml)
    font = escape_xml(props["font"])
    size = props["size"].cast("string")
    rpr = F.concat_ws(
        "",
        F.concat(F.lit('<w:rFonts w:ascii="'), font, F.lit('" w:hAnsi="'), font, F.lit('" w:cs="'), font, F.lit('"/>')),
        tag(props["bold"], "<w:b/>"),
        tag(props["italic"], "<w:i/>"),
        tag(props["strikeout"], "<w:strike/>"),
        F.concat(F.lit('<w:color w:val="'), props["fg"], F.lit('"/>')),
        F.concat(F.lit('<w:sz w:val="'), size, F.lit('"/><w:szCs w:val="'), size, F.lit('"/>')),
        tag(props["underline"], '<w:u w:val="single"/>'),
        F.concat(F.lit('<w:shd w:val="clear" w:color="auto" w:fill="'), props["bg"], F.lit('"/>')),
        F.concat(F.lit('<w:vertAlign w:val="'), props["valign"], F.lit('"/>')),
    )
    return F.concat(F.lit("<w:r>"), F.when(rpr == "", "").otherwise(F.concat(F.lit("<w:rPr>"), rpr, F.lit("</w:rPr>"))), F.lit('<w:t xml:space="preserve">'), escape_xml(text), F.lit("</w:t></w:r>"))


def schema_order(props: Column | str, order=K.TABLE_PROPERTY_ORDER) -> Column:
    """Property names sorted into schema order; names outside it keep their place at the end."""
    rank = F.array(*[F.lit(o) for o in order])
    keyed = F.transform(col(props), lambda p, i: F.struct(F.coalesce(F.nullif(F.array_position(rank, p), F.lit(0)), F.lit(len(order) + 1)).alias("r"), i.alias("i"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda s: s["p"])


# Fields of captions and listings.


def seq_name(instruction: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(instruction), r"SEQ\s+(\S+)", 1), F.lit(""))


def seq_field(name: Column) -> Column:
    return F.concat(F.lit(" SEQ "), escape_xml(name), F.lit(" \\* ARABIC "))


def tc_field(text: Column, kind: Column) -> Column:
    return F.concat(F.lit(' TC "'), escape_xml(text), F.lit('" \\f '), F.when(kind == "figure", "F").otherwise("T"), F.lit(' \\l "1" '))


def listing_field(kind: Column) -> Column:
    return F.concat(F.lit(" "), lookup(kind, K.LISTING_FIELDS), F.lit(" "))


def page_ref_field(bookmark: Column) -> Column:
    return F.concat(F.lit(" PAGEREF "), bookmark, F.lit(" \\h "))


def math_markers_to_tex(text: Column | str) -> Column:
    return F.regexp_replace(col(text), "(?s)PMCzzz([0-9A-Fa-f]{6})zzz(.*?)zzzPMCENDzzz", r"{\\color[HTML]{$1} $2}")


def neutral_caption_style(style: Column | str, has_seq: Column) -> Column:
    """A literal-numbered caption loses its style, so it is not numbered a second time."""
    return F.when((col(style) == "Caption") & ~has_seq, F.lit(None)).otherwise(col(style))


def normalize_first_paragraph(style: Column | str) -> Column:
    return F.when(col(style) == "FirstParagraph", "BodyText").otherwise(col(style))


# Marks around coloured math in page source.
_MARK_OPEN, _MARK_CLOSE, _MARK_END = "@@PMC:", "@@", "@@PMCEND@@"
# A command, an escaped character, a brace, or a run of anything else.
_TEX_TOKEN = r"(?s)\\[A-Za-z]+|\\.|[{}]|[^\\{}]+|\\$"
_BLANK, _MODEL = r"(?U)^\s*$", r"(?U)^\s*\[([^\]]*)\]\s*$"


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _resolved(model: Column, value: Column) -> Column:
    """Six upper-case digits: of a hex value, doubled if short, or of a name where no model is given."""
    digits = F.regexp_replace(value, "^#", "")
    hexes = F.when(digits.rlike("^[0-9A-Fa-f]{6}$"), F.upper(digits)).when(digits.rlike("^[0-9A-Fa-f]{3}$"), F.upper(F.regexp_replace(digits, "(.)", "$1$1")))
    named = F.when(model == "", lookup(F.lower(value), K.MATH_COLORS))
    return F.when(F.lower(model).isin("", "html"), F.coalesce(hexes, named))


def _brace_ends(tokens: Column) -> Column:
    """For each token the index of the brace that closes it, -1 where none does; a stack of open braces runs along."""
    start = F.struct(F.array().cast("array<int>").alias("open"), F.array().cast("array<struct<at:int,end:int>>").alias("pairs"))

    def step(s: Column, t: Column) -> Column:
        depth = F.size(s["open"])
        top = F.when(depth > 0, F.element_at(s["open"], F.greatest(depth, F.lit(1))))
        closing = (t["t"] == "}") & (depth > 0)
        opened = F.when(t["t"] == "{", F.concat(s["open"], F.array(t["i"]))).when(closing, F.slice(s["open"], 1, depth - 1)).otherwise(s["open"])
        pairs = F.when(closing, F.concat(s["pairs"], F.array(F.struct(top.alias("at"), t["i"].alias("end"))))).otherwise(s["pairs"])
        return F.struct(opened.alias("open"), pairs.alias("pairs"))

    braces = F.filter(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda t: t["t"].isin("{", "}"))
    pairs = F.aggregate(braces, start, step)["pairs"]
    return let(F.map_from_entries(pairs), lambda ends: F.transform(tokens, lambda _, i: F.coalesce(F.try_element_at(ends, i), F.lit(-1))))


def _color_commands(tokens: Column, ends: Column) -> Column:
    """For each token null, or, if a command with both arguments starts there: where its text begins and ends, and its colour."""
    token, end = (lambda i: F.get(tokens, i)), (lambda i: F.coalesce(F.get(ends, i), F.lit(-1)))
    plain = lambda i: ~F.substring(token(i), 1, 1).isin("\\", "{", "}")

    def at(t: Column, i: Column) -> Column:
        # Between command and brace: nothing, white space, or a model in brackets.
        model = F.when(plain(i + 1) & token(i + 1).rlike(_MODEL), _trimmed(F.regexp_extract(token(i + 1), _MODEL, 1))).otherwise("")
        first = F.when(plain(i + 1), F.when(token(i + 1).rlike(_BLANK) | token(i + 1).rlike(_MODEL), i + 2)).otherwise(i + 1)

        def behind(arg: Column) -> Column:
            past = end(arg["from"]) + 1
            second = F.when(plain(past), F.when(token(past).rlike(_BLANK), past + 1)).otherwise(past)
            named = _trimmed(F.array_join(F.slice(tokens, arg["from"] + 2, past - arg["from"] - 2), ""))
            made = lambda two: F.when(end(two) >= 0, F.struct((two + 1).alias("from"), end(two).alias("until"), _resolved(arg["model"], named).alias("color")))
            return F.when(end(arg["from"]) >= 0, let(second, made))

        return F.when(t.isin("\\color", "\\textcolor"), let(F.struct(first.alias("from"), model.alias("model")), behind))

    return F.transform(tokens, at)


def _marked(tokens: Column, commands: Column) -> Column:
    """Tokens with commands replaced: arguments skipped, a mark where a coloured text begins and one where it ends."""
    state = "struct<out:array<string>,skip:int,open:array<struct<until:int,color:string>>>"
    start = F.struct(F.array().alias("out"), F.lit(0).alias("skip"), F.array().alias("open")).cast(state)

    def step(s: Column, t: Column) -> Column:
        depth = F.size(s["open"])
        top = F.when(depth > 0, F.element_at(s["open"], F.greatest(depth, F.lit(1))))
        i, c = t["i"], t["c"]
        start_mark = F.concat(F.lit(f"\\text{{{_MARK_OPEN}"), c["color"], F.lit(f"{_MARK_CLOSE}}}"))
        end_mark = F.when(top["color"].isNotNull(), f"\\text{{{_MARK_END}}}").otherwise("")
        closes = (depth > 0) & (i == top["until"])
        made = lambda out, skip, open_: F.struct(F.concat(s["out"], F.array(out)).alias("out"), skip.alias("skip"), open_.alias("open")).cast(state)
        return (
            F.when(i < s["skip"], s)
            .when(closes, made(end_mark, s["skip"], F.slice(s["open"], 1, depth - 1)))
            .when(c.isNotNull(), made(F.coalesce(start_mark, F.lit("")), c["from"], F.concat(s["open"], F.array(F.struct(c["until"], c["color"]).cast("struct<until:int,color:string>")))))
            .otherwise(made(t["t"], s["skip"], s["open"]))
        )

    numbered = F.transform(F.arrays_zip(tokens.alias("t"), commands.alias("c")), lambda t, i: F.struct(t["t"].alias("t"), t["c"].alias("c"), i.alias("i")))
    return F.array_join(F.aggregate(numbered, start, step)["out"], "")


def _tokens_marked(tex: Column) -> Column:
    parsed = lambda tokens: let(_brace_ends(tokens), lambda ends: let(_color_commands(tokens, ends), lambda commands: _marked(tokens, commands)))
    return let(F.regexp_extract_all(tex, F.lit(_TEX_TOKEN), 0), parsed)


def math_color_tokens(tex: Column | str) -> Column:
    """Two-argument colour commands as start and end marks; other forms stay as they are.

    Braces nest, which regular expressions cannot follow: folds over the formula's tokens with a
    stack array match them, however deep, in the JVM.  Formulas that name no colour command skip that.
    """
    t = col(tex)
    return F.when(t.contains("\\color") | t.contains("\\textcolor"), _tokens_marked(t)).otherwise(t)
