"""Licence signs in rendered documents: tags and notice phrases by Aho-Corasick, licence expressions by a shunting yard."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import cache
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from inkshard.llm.common import small_batches

#: What a licence asks of a user, from nothing to everything; unknown terms count as the most.
TERMS = ("public-domain", "permissive", "weak-copyleft", "copyleft", "network-copyleft", "restricted", "reserved", "unknown")

# Licence identifiers as tags and expressions write them, in lower case, and their terms.
LICENSES = {
    "cc0-1.0": "public-domain", "cc0": "public-domain", "unlicense": "public-domain", "0bsd": "public-domain", "pddl-1.0": "public-domain",
    "mit": "permissive", "mit-0": "permissive", "isc": "permissive", "zlib": "permissive", "bsl-1.0": "permissive", "python-2.0": "permissive",
    "apache": "permissive", "apache-1.1": "permissive", "apache-2.0": "permissive", "bsd": "permissive", "bsd-2-clause": "permissive", "bsd-3-clause": "permissive",
    "cc-by": "permissive", "cc-by-3.0": "permissive", "cc-by-4.0": "permissive",
    "mpl": "weak-copyleft", "mpl-1.1": "weak-copyleft", "mpl-2.0": "weak-copyleft", "lgpl": "weak-copyleft", "lgpl-2.1": "weak-copyleft", "lgpl-3.0": "weak-copyleft",
    "epl": "weak-copyleft", "epl-1.0": "weak-copyleft", "epl-2.0": "weak-copyleft", "cddl-1.0": "weak-copyleft",
    "gpl": "copyleft", "gpl-2.0": "copyleft", "gpl-3.0": "copyleft", "cc-by-sa": "copyleft", "cc-by-sa-3.0": "copyleft", "cc-by-sa-4.0": "copyleft", "gfdl": "copyleft", "gfdl-1.3": "copyleft",
    "agpl": "network-copyleft", "agpl-3.0": "network-copyleft", "sspl-1.0": "network-copyleft",
    "cc-by-nc": "restricted", "cc-by-nc-4.0": "restricted", "cc-by-nd": "restricted", "cc-by-nd-4.0": "restricted",
    "cc-by-nc-sa": "restricted", "cc-by-nc-sa-4.0": "restricted", "cc-by-nc-nd": "restricted", "cc-by-nc-nd-4.0": "restricted",
    "public-domain": "public-domain", "reserved": "reserved", "proprietary": "reserved",
}
#: Exceptions that let a work be linked or embedded without taking on the licence of the library.
LINKING_EXCEPTIONS = ("classpath-exception-2.0", "gcc-exception-2.0", "gcc-exception-3.1", "llvm-exception", "font-exception-2.0", "bison-exception-2.2", "linux-syscall-note")

#: Phrases ``(words, label, strength of the sign)``.
BASE_PHRASES = (("cc by", "cc-by", 0.9), ("general public license", "gpl", 0.9), ("all rights reserved", "reserved", 0.6))
OWN_PHRASES = (
    ("mit license", "mit", 0.9), ("apache license", "apache", 0.9), ("bsd license", "bsd", 0.9), ("isc license", "isc", 0.9), ("boost software license", "bsl-1.0", 0.9),
    ("mozilla public license", "mpl", 0.9), ("eclipse public license", "epl", 0.9), ("lesser general public license", "lgpl", 0.9), ("library general public license", "lgpl", 0.9),
    ("affero general public license", "agpl", 0.9), ("gnu gpl", "gpl", 0.9), ("gnu lgpl", "lgpl", 0.9), ("gnu agpl", "agpl", 0.9), ("free documentation license", "gfdl", 0.9),
    ("cc0", "cc0", 0.8), ("creative commons zero", "cc0", 0.9), ("cc by sa", "cc-by-sa", 0.9), ("cc by nc", "cc-by-nc", 0.9), ("cc by nd", "cc-by-nd", 0.9),
    ("cc by nc sa", "cc-by-nc-sa", 0.9), ("cc by nc nd", "cc-by-nc-nd", 0.9), ("creative commons attribution", "cc-by", 0.9),
    ("creativecommons org licenses by", "cc-by", 0.9), ("creativecommons org licenses by sa", "cc-by-sa", 0.9), ("creativecommons org licenses by nc", "cc-by-nc", 0.9),
    ("creativecommons org licenses by nd", "cc-by-nd", 0.9), ("creativecommons org publicdomain zero", "cc0", 0.9), ("opensource org licenses mit", "mit", 0.9), ("gnu org licenses gpl", "gpl", 0.9),
    ("apache org licenses", "apache", 0.9), ("permission is hereby granted free of charge", "mit", 0.8), ("redistribution and use in source and binary forms", "bsd", 0.8),
    ("released into the public domain", "public-domain", 0.8), ("no part of this publication may be reproduced", "reserved", 0.8), ("proprietary and confidential", "proprietary", 0.8),
)
#: Strings before an expression, in lower case, and whether the rest of the line must be one.
TAGS = (("spdx-license-identifier:", True), ("license-expression:", True), ("license:", False), ("licence:", False), ("licensed under", False), ("released under", False))
EXPRESSION_STRENGTH = 0.95

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LOWER_ONLY = bytes.maketrans(_UPPER, _UPPER.lower())
#: A-Z lower-cased and every ASCII character that is no letter or digit as a space.
_WORDS = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b > 127 else 32 for b in range(256))
_LINE_END = re.compile(r"""[ \t]*(?:[\n\r"'<>;]|\*/|-->|\Z)""")
_TOKEN = re.compile(r"[ \t]*([a-z0-9][a-z0-9.+_-]*?(?=-->|[^a-z0-9.+_-]|\Z)|[()])")
_PIECE = re.compile(r"""[ \t]*([^\s,"'<>;]+,?)""")
_PARTS = re.compile(r"[a-z0-9][a-z0-9.+_-]*|[()]")
_FILLERS = {"the", "a", "an", "license", "licence", "either", "terms", "of"}
_RANK = {name: i for i, name in enumerate(TERMS)}
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def license_name(identifier: str) -> str:
    """An identifier in lower case without the marks of "this version" and "or any later one"."""
    return re.sub(r"(\+|-only|-or-later)$", "", identifier.lower())


def evaluate(tokens: Iterable[str]) -> tuple[str, list[str]] | None:
    """Terms and licence names of an expression, None when it is none.

    A shunting yard: ``with`` binds closer than ``and``, that closer than ``or``; all bind to the left.
    The user may choose at an ``or`` (the freer terms) and must keep both sides of an ``and`` (the stricter).
    ``with`` follows one licence and names an exception; a linking exception makes copyleft weak.
    """
    values: list[tuple[int, str | None]] = []  # (terms, name of a single licence)
    waiting: list[str] = []
    names: list[str] = []
    operand, exception = True, False  # what may come next

    def reduce() -> bool:
        op, (b, name_b), (a, name_a) = waiting.pop(), values.pop(), values.pop()
        if op == "with":
            if name_a is None:
                return False
            if name_b in LINKING_EXCEPTIONS and _RANK["copyleft"] <= a <= _RANK["network-copyleft"]:
                a = _RANK["weak-copyleft"]
        values.append((a if op == "with" else min(a, b) if op == "or" else max(a, b), None))
        return True

    for token in tokens:
        if token in _PRECEDENCE:
            if operand:
                return None
            while waiting and waiting[-1] != "(" and _PRECEDENCE[waiting[-1]] >= _PRECEDENCE[token]:
                if not reduce():
                    return None
            waiting.append(token)
            operand, exception = True, token == "with"
        elif token == "(":
            if not operand or exception:
                return None
            waiting.append(token)
        elif token == ")":
            if operand:
                return None
            while waiting and waiting[-1] != "(":
                if not reduce():
                    return None
            if not waiting:
                return None
            waiting.pop()
            values.append((values.pop()[0], None))  # what stood in brackets takes no exception
        else:
            if not operand:
                return None
            name = license_name(token)
            values.append((_RANK[LICENSES.get(name, "unknown")], token if exception else name))
            if not exception:
                names.append(name)
            operand = exception = False
    if operand:
        return None
    while waiting:
        if waiting[-1] == "(" or not reduce():
            return None
    return TERMS[values[0][0]], sorted(set(names))


def read_expression(text: str, at: int, strict: bool) -> tuple[str, str, list[str]] | None:
    """``(expression, terms, names)`` that begins at a place of a lower-case text, in one line.

    ``strict``: the line, up to the end of a comment or quotation, is an expression, whatever its names.
    Otherwise it goes as far as known names, operators and brackets do, past words like "the"; operators left over
    at its end are dropped.  No character is read twice for different places: neither form reads past another tag.
    """
    tokens = []
    while m := (_TOKEN if strict else _PIECE).match(text, at):
        parts = [m[1]] if strict else _PARTS.findall(piece := m[1].rstrip(".,"))
        if not strict and ("".join(parts) != piece or not all(p in _PRECEDENCE or p in "()" or p in _FILLERS or license_name(p) in LICENSES or p in LINKING_EXCEPTIONS for p in parts)):
            break
        tokens += parts if strict else [p for p in parts if p not in _FILLERS]
        at = m.end()
        if not strict and m[1].endswith((",", ".")):
            break
    if strict and not _LINE_END.match(text, at):
        return None
    while not strict and tokens and (tokens[-1] in _PRECEDENCE or tokens[-1] == "("):
        tokens.pop()
    found = evaluate(tokens)
    return found and (" ".join(tokens), *found)


@cache
def _automata(phrases: tuple[tuple[str, str, float], ...]):
    """Two automata, over words between spaces and over lower-case text."""
    import ahocorasick

    words, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label, strength in phrases:
        words.add_word(f" {phrase} ", (phrase, label, strength))
    for tag, strict in TAGS:
        tags.add_word(tag, (tag, strict))
    words.make_automaton()
    tags.make_automaton()
    return words, tags


def scan(text: bytes, phrases: tuple[tuple[str, str, float], ...]) -> dict:
    """Signs of one text, given in UTF-8; bytes stand for themselves in the automata."""
    words, tags = _automata(phrases)
    split = text.translate(_WORDS).split()
    joined = f" {b' '.join(split).decode('latin-1')} "
    notices, at, passed = [], 0, 0
    starts = sorted((end - len(phrase) - 1, phrase, label, strength) for end, (phrase, label, strength) in words.iter(joined))
    for start, phrase, label, _ in starts:
        at, passed = at + joined.count(" ", passed, start), start
        notices.append({"word": at, "phrase": phrase, "label": label})
    lower, expressions, seen = text.translate(_LOWER_ONLY).decode("latin-1"), [], 0
    for end, (tag, strict) in tags.iter(lower):
        begin = end + 1 - len(tag)
        if begin < seen:  # "license:" at the end of a longer tag, or inside an expression
            continue
        if found := read_expression(lower, end + 1, strict):
            seen = end + 1
            expressions.append({"byte": begin, "tag": tag, "expression": found[0], "terms": found[1], "names": found[2]})
    labels = sorted({n["label"] for n in notices} | {name for e in expressions for name in e["names"]})
    terms = [_RANK[LICENSES.get(n["label"], "unknown")] for n in notices] + [_RANK[e["terms"]] for e in expressions]
    signs = sorted({(phrase, strength) for _, phrase, _, strength in starts} | {(e["expression"], EXPRESSION_STRENGTH) for e in expressions})
    return {
        "n_words": len(split),
        "notices": notices,
        "expressions": expressions,
        "labels": labels,
        "terms": TERMS[max(terms)] if terms else None,
        "score": 1.0 - prod(1.0 - s for _, s in signs),
    }


def _struct(**fields) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


_LONG, _STRING = LongType(), StringType()
_FOUND = _struct(
    n_words=_LONG,
    notices=ArrayType(_struct(word=_LONG, phrase=_STRING, label=_STRING)),
    expressions=ArrayType(_struct(byte=_LONG, tag=_STRING, expression=_STRING, terms=_STRING, names=ArrayType(_STRING))),
    labels=ArrayType(_STRING),
    terms=_STRING,
    score=DoubleType(),
)
_ARROW = pa.struct(
    {
        "n_words": pa.int64(),
        "notices": pa.list_(pa.struct({"word": pa.int64(), "phrase": pa.string(), "label": pa.string()})),
        "expressions": pa.list_(pa.struct({"byte": pa.int64(), "tag": pa.string(), "expression": pa.string(), "terms": pa.string(), "names": pa.list_(pa.string())})),
        "labels": pa.list_(pa.string()),
        "terms": pa.string(),
        "score": pa.float64(),
    }
)


def _scanner(phrases: tuple[tuple[str, str, float], ...]):
    @F.arrow_udf(_FOUND)
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([scan(t, phrases) for t in texts.cast(pa.binary()).to_pylist()], _ARROW)

    return found


def scan_licenses(documents: DataFrame, phrases: Sequence[tuple[str, str, float]] = BASE_PHRASES + OWN_PHRASES) -> DataFrame:
    """``(doc_id, n_words, notices, expressions, labels, terms, score)``, one row for each row of documents ``(doc_id, text)``.

    Documents are pages as ``render_pages`` gives them.  Words are runs of ASCII letters, digits and all characters
    beyond ASCII, A-Z lower-cased.  ``notices`` are the places ``(word, phrase, label)`` where the words of a phrase
    ``(words, label, strength)`` stand one after the other, overlapping ones too, by place and phrase.
    ``expressions`` are licence expressions behind a tag or "licensed under" (``byte`` of the tag, ``tag``,
    ``expression``, ``terms``, ``names``); lines that do not parse give none.  ``labels`` are those of notices and
    the names in expressions, each once, sorted.  ``terms`` is the strictest of ``TERMS`` that any sign
    states, null without a sign.  ``score`` says how surely the text states a licence: 1 less the product of (1 -
    strength) over different phrases and expressions, 0 without a sign.

    Null and empty texts have no words and no signs.  Rows that repeat a doc_id are judged one by one; other columns are
    ignored.  An empty table gives an empty one.  Rows stay where they are: no shuffle.
    """
    own = tuple((" ".join(p.split()), label, float(s)) for p, label, s in phrases)
    text = F.coalesce("text", F.lit(""))
    return small_batches(documents).select("doc_id", _scanner(own)(text).alias("f")).select("doc_id", "f.*")
