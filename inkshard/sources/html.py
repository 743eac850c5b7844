"""HTML shredded into tokens, blocks and nodes.

Tokens and blocks come from regular expressions inside the JVM, one row in, no shuffle.
Only the node tree needs a parser; it is a table function around the standard library's.

A ``<`` begins a tag only before a letter, ``/`` and a letter, ``!`` or ``?``, and only if the tag
is closed; any other is text.  Quoted attribute values may hold ``>``.
"""

from __future__ import annotations

import re
from functools import cache
from html.entities import html5
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from inkshard.functions.text import col
from inkshard.sources.shred import shred

# Up to the end of a tag, past quoted values; possessive, so a long tag costs no stack.
_REST = r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>"""
_TAG = rf"</?[a-z]{_REST}|</?[a-z][^>]*>|<[!?][^>]*>"
_RAW = r"<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
TOKEN = rf"(?is){_RAW}|{_TAG}|[^<]+|<[^<]*"

# Elements that start a block of their own.
BLOCK_TAGS = [
    "address", "article", "aside", "blockquote", "body", "center", "dd", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol",
    "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
]
# Elements without content.
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]

_DROPPED = rf"(?is){_RAW}|<head\b.*?</head\s*>|<![^>]*>|<\?[^>]*>"
_BLOCK = r"(?i)<(/?)(" + "|".join(BLOCK_TAGS) + rf")\b{_REST}"
_BOLD = rf"(?i)<(?:b|strong)\b{_REST}([^\x01]*?)</(?:b|strong)\s*>"
_CUT, _END, _BREAK = "\x01", "\x02", "\x03"


def html_tokens(df: DataFrame, html: str = "html") -> DataFrame:
    """``(doc_id, pos, tok, kind, tag)``: tokens that join to the whole body; comments, scripts and styles are one token each.

    A ``<`` that begins no tag starts a text token.  A null or empty body has no tokens.
    """
    toks = df.select("doc_id", F.posexplode(F.regexp_extract_all(F.col(html), F.lit(TOKEN), F.lit(0))).alias("pos", "tok"))
    return toks.select("doc_id", "pos", "tok", token_kind("tok").alias("kind"), token_tag("tok").alias("tag"))


def token_kind(tok: Column | str) -> Column:
    t = col(tok)
    closed = t.endswith(">")
    return (
        F.when(t.startswith("<!--") & closed, "comment")
        .when(t.rlike("^<[!?]") & closed, "doctype")
        .when(~t.rlike("^</?[A-Za-z]") | ~closed, "text")
        .when(t.rlike("(?i)^<script\\b"), "script")
        .when(t.rlike("(?i)^<style\\b"), "style")
        .when(t.startswith("</"), "close")
        .otherwise("open")
    )


def token_tag(tok: Column | str) -> Column:
    """Lower-cased name of a tag, null for other tokens."""
    return F.when(col(tok).endswith(">"), F.nullif(F.lower(F.regexp_extract(col(tok), r"^</?([A-Za-z][A-Za-z0-9]*)", 1)), F.lit("")))


@cache
def _reference_map() -> str:
    """SQL map of the named references, from the standard library's table; a no-break space counts as a space."""
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    names = {n: c for n, c in html5.items() if n.endswith(";")} | {"nbsp;": " ", "NonBreakingSpace;": " "}
    return "map(" + ", ".join(f"{quoted(n)}, {quoted(c)}" for n, c in sorted(names.items())) + ")"


def _reference(ref: Column) -> Column:
    """The characters of one reference ``&...;``; an unknown name stays as it is.

    Numbers of the C1 range are read as Windows-1252; numbers of no character become U+FFFD.
    """
    named = F.element_at(F.expr(_reference_map()), F.substring(ref, 2, 64))
    number = F.when(ref.rlike("^&#[xX]"), F.conv(F.regexp_extract(ref, "^&#[xX]0*([0-9a-fA-F]{1,7});$", 1), 16, 10)).otherwise(F.regexp_extract(ref, "^&#0*(\\d{1,7});$", 1))
    code = number.try_cast("int")
    c1 = [bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0)]
    valid = code.between(9, 10) | (code == 13) | code.between(32, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    char = F.when(code.between(0x80, 0x9F), F.get(F.array(*map(F.lit, c1)), code - 0x80)).when(valid, F.decode(F.unhex(F.lpad(F.hex(code.cast("bigint")), 8, "0")), "UTF-32")).otherwise("\ufffd")
    return F.when(ref.startswith("&#"), F.when(code == 160, " ").otherwise(char)).otherwise(F.coalesce(named, ref))


_REFERENCE = "&(?:#[xX][0-9a-fA-F]{1,12}|#[0-9]{1,12}|[A-Za-z][A-Za-z0-9]{1,40});"


def decode_entities(text: Column) -> Column:
    """Named, decimal and hexadecimal references decoded, each once."""
    parts, refs = F.split(text, _REFERENCE, -1), F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    decoded = F.array_join(F.zip_with(parts, F.transform(refs, _reference), lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")
    return F.when(text.contains("&"), decoded).otherwise(text)


def flat_page(html: Column, bold: str = "$1") -> Column:
    """Body text with a cut mark and the tag's name where block tags stood.

    Bold closed within its block is marked up with ``bold``, other inline tags are gone,
    references decoded and white space collapsed.
    """
    t = F.regexp_replace(html, "[\x01-\x03\x06\x07]", "")
    t = F.regexp_replace(t, _DROPPED, "")
    t = F.regexp_replace(t, _BLOCK, _CUT + "$1$2" + _END)
    t = F.regexp_replace(t, _BOLD, bold)
    t = F.regexp_replace(t, rf"(?i)<br\b{_REST}", _BREAK)
    t = F.regexp_replace(t, rf"(?i){_TAG}", "")
    t = F.regexp_replace(t, r"[ \t\r\n\f]{2,}|[\t\r\n\f]", " ")
    return decode_entities(F.regexp_replace(t, " ?" + _BREAK + " ?", "\n"))


def page_segments(html: Column, bold: str = "$1") -> Column:
    """The blocks of a page as an array of ``(tag, text)``: a block tag and the text up to the next one.

    An item whose text sits in an inner paragraph stays an item.
    """
    flat = F.regexp_replace(flat_page(html, bold), "(?i)" + _CUT + "li" + _END + "[ \n]*" + _CUT + "p" + _END, _CUT + "li" + _END)
    tag = lambda seg: F.when(seg.contains(_END), F.lower(F.substring_index(seg, _END, 1))).otherwise("")
    return F.transform(F.split(flat, _CUT), lambda seg: F.struct(tag(seg).alias("tag"), F.btrim(F.substring_index(seg, _END, -1), F.lit(" \n")).alias("text")))


def html_segments(df: DataFrame, html: str = "html", bold: str = "$1") -> DataFrame:
    """``(doc_id, pos, tag, text)``: the same, a row for each block."""
    return df.select("doc_id", F.posexplode(page_segments(F.col(html), bold)).alias("pos", "seg")).select("doc_id", "pos", "seg.tag", "seg.text")


class _Tree(HTMLParser):
    """Collects nodes in document order, closing what HTML lets authors leave open."""

    # Opening one of these ends an open element of the second group.
    IMPLIED = {
        "li": {"li"},
        "dt": {"dt", "dd"},
        "dd": {"dt", "dd"},
        "tr": {"tr", "td", "th"},
        "td": {"td", "th"},
        "th": {"td", "th"},
        "option": {"option"},
    }
    STOPS = {"ol", "ul", "dl", "table", "select"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.open, self.pos = [], [], 0

    def _close_to(self, depth):
        while len(self.open) > depth:
            self.nodes[self.open.pop()][1] = self.pos
            self.pos += 1

    def _implied(self, tag):
        ends = self.IMPLIED.get(tag, {"p"} if tag in BLOCK_TAGS else set())
        for depth in range(len(self.open) - 1, -1, -1):
            name = self.nodes[self.open[depth]][4]
            if name in ends:
                self._close_to(depth)
            elif name in self.STOPS:
                break

    def handle_starttag(self, tag, attrs):
        self._implied(tag)
        parent = self.open[-1] if self.open else None
        node = [self.pos, None, len(self.open) + 1, None if parent is None else self.nodes[parent][0], tag, {k: v or "" for k, v in attrs}, ""]
        self.pos += 1
        self.nodes.append(node)
        if tag in VOID_TAGS:
            node[1] = self.pos
            self.pos += 1
        else:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self._close_to(len(self.open) - 1)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[depth]][4] == tag:
                self._close_to(depth)
                break

    def handle_data(self, data):
        if self.open:
            self.nodes[self.open[-1]][6] += data


class _Drawings(_Tree):
    """Notes where the markup of each outermost drawing begins and ends."""

    def __init__(self, html: str):
        super().__init__()
        self.html, self.drawings = html, []
        self.lines = [0, *(m.end() for m in re.finditer("\n", html))]

    def at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        inside = any(self.nodes[i][4] == "svg" for i in self.open)
        super().handle_starttag(tag, attrs)
        if tag == "svg" and not inside:
            self.drawings.append([self.nodes[-1], self.at(), len(self.html)])

    def _close_to(self, depth):
        closes = [self.nodes[i] for i in self.open[depth:]]
        super()._close_to(depth)
        for d in self.drawings[-1:]:
            if any(d[0] is n for n in closes):
                end = self.html.find(">", self.at())
                here = self.html.startswith(("</svg", "</SVG"), self.at()) or d[1] == self.at()
                d[2] = end + 1 if here and end >= 0 else self.at()


NODE = "pos int, close_pos int, depth int, parent_pos int, tag string, attrs map<string,string>, text string"


def _parse(html: str) -> list[tuple]:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    tree._close_to(0)
    return [tuple(n) for n in tree.nodes]


def html_nodes(df: DataFrame, html: str = "html") -> DataFrame:
    """``(doc_id, pos, close_pos, depth, parent_pos, tag, attrs, text)`` in document order; nothing for a missing body.

    ``pos`` and ``close_pos`` number the opening and closing of nodes, so a node lies
    inside another exactly when its ``pos`` lies between them.
    """
    return shred(df.select("doc_id", html), html, _parse, NODE)


def _drawings(html: str) -> list[tuple]:
    tree = _Drawings(html)
    tree.feed(html)
    tree.close()
    end = len(html)
    for d in tree.drawings:
        if d[0][1] is None:
            d[2] = end
    return [(n[0], n[5], html[a:b]) for n, a, b in tree.drawings]


def html_drawings(df: DataFrame, html: str = "html") -> DataFrame:
    """``(doc_id, pos, attrs, outer_html)`` of each drawing that is in no other; an unclosed one runs to the end."""
    return shred(df.select("doc_id", html), html, _drawings, "pos int, attrs map<string,string>, outer_html string")


def html_chains(df: DataFrame, kinds: dict[str, str], html: str = "html") -> DataFrame:
    """``(doc_id, pos, tag, text, chain)`` of elements with text: the formatting elements around it, the element included.

    ``chain`` lists ``(kind, style)`` from the outside in, for elements in ``kinds``.  The same kind twice in a row without
    a style says nothing new and is listed once, so tags that are never closed do not pile up.
    """

    def parse(body: str) -> list[tuple]:
        nodes, chains, out = _parse(body), {}, []
        for pos, _, _, parent, tag, attrs, text in nodes:
            chain = chains.get(parent, ())
            if tag in kinds:
                step = (kinds[tag], attrs.get("style"))
                if step[1] is not None or step not in chain[-1:]:
                    chain = (*chain, step)
            chains[pos] = chain
            if text:
                out.append((pos, tag, text, [{"kind": k, "style": s} for k, s in chain]))
        return out

    return shred(df.select("doc_id", html), html, parse, "pos int, tag string, text string, chain array<struct<kind:string,style:string>>")


@udtf(returnType=NODE)
class HtmlNodes:
    """The same for SQL."""

    def eval(self, html: str):
        if html is not None:
            yield from _parse(html)


def register_html_nodes(spark) -> None:
    """Make ``html_nodes`` usable from SQL: ``FROM pages, LATERAL html_nodes(html)``."""
    spark.udtf.register("html_nodes", HtmlNodes)
