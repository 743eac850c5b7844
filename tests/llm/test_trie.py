"""The trie of documents' beginnings against a dictionary of all of them."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from inkshard.llm import trie as T

SCHEMA = "doc_id long, pos long, kind string, text string, node string, depth string, d int"


def brute(sequences):
    """Rows of nodes from ``{doc_id: [(kind, text), ...]}``."""
    members = defaultdict(list)
    for doc, blocks in sequences.items():
        for d in range(len(blocks) + 1):
            members[tuple(blocks[:d])].append(doc)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    least = {n: min((m for m in ms if m is not None), default=None) for n, ms in members.items()}
    leaves, gain = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        gain[node] = sum(gain[c] for c in children[node]) + (len(node[-1][1]) * (len(members[node]) - 1) if node else 0)
    out = []
    for node, ms in members.items():
        ends = ",".join(str(m) for m in sorted(m for m in ms if m is not None and len(sequences[m]) == len(node)))
        out.append((least[node], len(node), least[node[:-1]] if node else None, len(ms), len(children[node]), leaves[node], gain[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def sequences(blocks, documents=()):
    out = {d: [] for d in documents}
    for r in blocks.select("doc_id", F.coalesce("pos", F.lit(-1 << 62)).alias("pos"), F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.lit(1), F.coalesce("kind", F.lit("")), F.coalesce("text", F.lit(""))).alias("h")).collect():
        out.setdefault(r.doc_id, []).append((r.pos, r.h, r.kind, r.text))
    return {d: [b[2:] for b in sorted(bs)] for d, bs in out.items()}


def check(spark, blocks, documents=None):
    trie = T.build_trie(blocks, documents)
    nodes = trie.nodes.join(T.ends_digest(trie.ends), "node", "left").select(
        "first_doc_id", "depth", "parent_first_doc_id", "n_docs", "n_children", "n_leaves", "saved_chars", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))
    )
    want = brute(sequences(blocks, [r.doc_id for r in documents.collect()] if documents is not None else ()))
    assert sorted(str(tuple(r)) for r in nodes.collect()) == want
    return trie


def test_fattest_numbers(spark):
    rows = [(a, b) for b in range(1, 40) for a in range(b)]
    got = {(r.a, r.b): r.f for r in spark.createDataFrame(rows, "a long, b long").withColumn("f", T.fattest(F.col("a"), F.col("b"))).collect()}
    assert all(got[a, b] == max(range(a + 1, b + 1), key=lambda n: n & -n) for a, b in rows)


def test_awkward_rows(spark):
    """Nulls everywhere, ties, repeated rows, a null doc_id, a document inside another, documents without blocks."""
    rows = [
        (1, 0, "h", "a"), (1, 1, "p", "b"), (1, 2, "p", "c"), (2, 0, "h", "a"), (2, 1, "p", "b"), (3, 5, "h", "a"), (4, None, None, None), (4, 0, "", ""), (5, 0, "p", "b"), (5, 0, "h", "a"), (5, 0, "h", "a"),
        (6, 1, "h", "a"), (6, 2, "p", "b"), (6, 3, "p", "c"), (7, 0, "h", "a"), (7, 1, "p", "x" * 100_000), (None, 0, "h", "a"), (None, 1, "own", "é"), (-8, 0, "ha", ""), (-8, 1, "h", "a"),
    ]
    blocks = spark.createDataFrame([(*r, "mine", "mine", 1) for r in rows], SCHEMA).repartition(3)
    check(spark, blocks, spark.createDataFrame([(9,), (10,), (1,)], "doc_id long"))


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    trie = T.build_trie(none)
    assert trie.nodes.collect() == [] and trie.ends.collect() == [] and T.ends_digest(trie.ends).collect() == []
    only = T.build_trie(none, spark.createDataFrame([(3,), (2,)], "doc_id long"))
    assert [tuple(r)[1:] for r in only.nodes.collect()] == [(0, None, 2, None, 2, 0, 1, 0)]


def test_deep_paths(spark):
    """One long document, others that leave it at every depth, end on it or equal it; batches stay few."""
    rng, base = random.Random(3), [("p", f"{i}") for i in range(90)]
    docs = {0: base, 1: base[:40], 2: list(base)}
    for k in range(3, 60):
        at = rng.randrange(0, 90)
        docs[k] = base[:at] + [("q", f"{rng.randrange(3)}") for _ in range(rng.randrange(0, 9))]
    rows = [(k, i, kind, text, "", "", 0) for k, bs in docs.items() for i, (kind, text) in enumerate(bs)]
    check(spark, spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(k,) for k in docs], "doc_id long"))


def test_shared_beginnings(spark):
    """Rebuilt documents: a missing base, one that is too short, one that leaves no blocks."""
    docs = {100: 3, 101: 5, 102: 1, 103: 6, 205: 4, 300: 1, 304: 2}
    rows = [(k, i * 10, "p", f"{k} {i}", "", "", 0) for k, n in docs.items() for i in range(n)] + [(None, 1, None, None, "", "", 0)]
    blocks, documents = T.share_beginnings(spark.createDataFrame(rows, SCHEMA), 100, F.col("doc_id") % 6)
    got = defaultdict(list)
    for r in blocks.orderBy("doc_id", "pos").collect():
        got[r.doc_id].append(r.text)
    want = {}
    for k, n in docs.items():
        h, base = k % 6, k - k % 100
        want[k] = [f"{base} {i}" for i in range(min(h, docs.get(base, 0)))] + [f"{k} {i}" for i in range(h, n)]
    assert got == {k: v for k, v in want.items() if v} | {None: [""]}
    assert sorted(str(r.doc_id) for r in documents.collect()) == sorted(map(str, [*docs, None]))


def test_blocks_of_pages(spark):
    """The project's own records: blocks of pages, one template around all of them."""
    from inkshard.operators.render import page_blocks
    from inkshard.plans.views import pages

    raw = pages(spark, "/root/testdata/sf0.001").withColumn("html", F.concat(F.lit("<h1>Site</h1><p>All pages</p>"), "html"))
    blocks = page_blocks(raw).select("doc_id", F.posexplode("blocks").alias("pos", "b")).select("doc_id", "pos", "b.kind", "b.text")
    trie = check(spark, blocks.cache())
    assert trie.nodes.filter("depth <= 2 AND n_docs = 50").count() == 3


def test_a_template_for_most(spark):
    """A beginning that most documents share, in many copies, is one path."""
    rows = [(k, i, "p", f"t{i}" if i < 4 or k % 3 == 0 else f"{k}", "", "", 0) for k in range(400) for i in range(6)]
    trie = check(spark, spark.createDataFrame(rows, SCHEMA).repartition(8))
    assert trie.nodes.filter("n_docs = 400").count() == 5
