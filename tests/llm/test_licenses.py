"""Licence scans against patterns over word lists, and expressions against their trees."""

import random
import re

import pytest
from pyspark.sql import functions as F

from inkshard.llm import licenses as L
from inkshard.llm.plans import op12_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
HARD = [
    (20, "CC-BY cc by\tCC/BY CC BYE ccby"), (21, "General\nPublic  License, general public general public license"), (22, "All Rights Reserved. all rights reserved all"),
    (23, "// SPDX-License-Identifier: (MIT OR GPL-2.0+) AND Apache-2.0\nx"), (24, "<!-- SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 -->"),
    (25, "License: see the file"), (26, "Licensed under the MIT License or Apache-2.0. All rights reserved."), (27, "écc by É"), (28, "cc by nc sa 4.0, Creative Commons Attribution"),
    (29, "SPDX-License-Identifier: MIT OR"), (30, "SPDX-License-Identifier: LicenseRef-own"), (31, "/* spdx-license-identifier: isc*/"),
    (32, "'license: the (ISC or MIT), and more'"), (None, "cc by"),
]


def brute(doc_id, text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    places = []
    for phrase, label, _ in L.BASE_PHRASES + L.OWN_PHRASES:
        p = phrase.split()
        places += [(i, phrase, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return (doc_id, len(words), sorted(places))


def check(df):
    got = L.scan_licenses(df).collect()
    want = [brute(r.doc_id, r.text) for r in df.collect()]
    assert sorted(str((r.doc_id, r.n_words, [tuple(n) for n in r.notices])) for r in got) == sorted(map(str, want))
    for r in got:
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.notices or r.expressions) == (r.terms is not None)
        assert r.labels == sorted({n.label for n in r.notices} | {x for e in r.expressions for x in e.names})
    return {r.doc_id: r for r in got}


def test_awkward_rows(spark, awkward, nothing):
    check(awkward)
    got = check(spark.createDataFrame(HARD, "doc_id long, text string").withColumn("labels", F.lit("mine")))
    assert [(e.expression, e.terms) for e in got[23].expressions] == [("( mit or gpl-2.0+ ) and apache-2.0", "permissive")]
    assert got[24].terms == "weak-copyleft" and got[24].labels == ["gpl-2.0"]
    assert not got[25].expressions and not got[29].expressions
    assert got[26].expressions[0].expression == "mit or apache-2.0" and got[26].terms == "reserved"
    assert got[30].terms == "unknown"
    assert [e.terms for e in got[31].expressions] == ["permissive"] and got[32].expressions[0].names == ["isc", "mit"]
    assert L.scan_licenses(nothing).collect() == []


def test_rendered_pages(documents):
    extra = documents.withColumn("text", F.concat("text", F.lit("\n\nReleased under the MIT License.")))
    assert all("mit" in r.labels and r.terms for r in check(extra).values())


def test_given_documents(spark):
    """The query's columns from word lists, over whole tables."""
    sf = "/root/testdata/sf0.01"
    base = {p for p, _, _ in L.BASE_PHRASES}
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        _, n, places = brute(r.doc_id, r.text)
        own = [(w, label) for w, phrase, label in places if phrase in base]
        want[r.doc_id] = (n, len(own), min((w for w, _ in own), default=None), max((w for w, _ in own), default=None), ",".join(sorted({x for _, x in own})))
    rows = op12_licenses(spark, sf).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows} == want
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) for r in rows if r.base_labels)
    assert sum(r.n_base for r in rows) > 0


def tree(rng, depth):
    """Text of a random expression, its terms and names; ``or`` inside ``and`` stands in brackets."""
    known = sorted(L.LICENSES)
    if depth == 0 or rng.random() < 0.2:
        name = rng.choice(known)
        rank = L.TERMS.index(L.LICENSES[name])
        if rng.random() < 0.3:
            exception = rng.choice([*L.LINKING_EXCEPTIONS, "own-exception"])
            linked = exception != "own-exception" and L.LICENSES[name] in ("copyleft", "network-copyleft")
            return f"{name} with {exception}", L.TERMS.index("weak-copyleft") if linked else rank, {name}, 3
        return name, rank, {name}, 3
    op = rng.choice(["and", "or"])
    (a, ra, na, pa), (b, rb, nb, pb) = tree(rng, depth - 1), tree(rng, depth - 1)
    mine = L._PRECEDENCE[op]
    a, b = (f"({x})" if p < mine or rng.random() < 0.2 else x for x, p in ((a, pa), (b, pb)))
    return f"{a} {op} {b}", (min if op == "or" else max)(ra, rb), na | nb, mine


@pytest.mark.parametrize("seed", range(200))
def test_expressions_against_their_trees(seed):
    text, rank, names, _ = tree(random.Random(seed), seed % 6)
    _, terms, found = L.read_expression(text, 0, True)
    assert terms == L.TERMS[rank] and found == sorted({L.license_name(n) for n in names})


@pytest.mark.parametrize("text", ["", "and", "mit mit", "mit or", "(mit", "mit)", "mit with", "(mit) with gcc-exception-3.1", "mit with (gcc-exception-3.1)", "()", "mit & isc", "with mit"])
def test_no_expression(text):
    assert L.read_expression(text, 0, True) is None


def test_deep_nesting():
    n = 50_000
    assert L.read_expression("(" * n + "mit" + ")" * n, 0, True)[1] == "permissive"


def test_many_tags_in_one_line():
    """Read once: neither form of expression runs on past another tag."""
    for tag in ("license: the ", "licensed under ", "spdx-license-identifier: mit "):
        found = L.scan(tag.encode() * 50_000, L.BASE_PHRASES)
        assert len(found["expressions"]) == tag.startswith("spdx")  # the last one ends the text
