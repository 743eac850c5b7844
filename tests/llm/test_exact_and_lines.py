import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from inkshard.llm.exact import exact_copies
from inkshard.llm.lines import apply_keep, line_bitmaps

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_copies(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r.text or "").translate(LOWER)].append(r.doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(map(str, out))


def test_copies(awkward, nothing, documents):
    for df in (awkward, documents):
        assert sorted(str(tuple(r)) for r in exact_copies(df).collect()) == brute_copies(df.collect())
    assert exact_copies(nothing).collect() == []


def test_collisions_are_told_apart(awkward):
    weak = lambda text: F.substring(F.unhex(F.md5(text.cast("binary"))), 1, 0)
    assert sorted(str(tuple(r)) for r in exact_copies(awkward, weak).collect()) == brute_copies(awkward.collect())


def brute_lines(rows, min_chars, min_documents):
    key = lambda line: line.strip(" \t\n\v\f\r").translate(LOWER)
    held = defaultdict(set)
    for r in rows:
        if r.doc_id is not None:
            for line in (r.text or "").split("\n"):
                if len(key(line)) >= min_chars:
                    held[key(line)].add(r.doc_id)
    out = []
    for r in rows:
        lines = (r.text or "").split("\n")
        kept = [x for x in lines if r.doc_id is None or len(held[key(x)]) < min_documents or max(held[key(x)]) == r.doc_id]
        out.append((r.doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(map(str, out))


def got_lines(df, *limits):
    rows = line_bitmaps(df, *limits).select("doc_id", "n_lines", "n_dropped", apply_keep(F.col("text"), F.col("keep")))
    return sorted(str(tuple(r)) for r in rows.collect())


def test_lines(spark, awkward, nothing, documents):
    assert got_lines(awkward, 5, 2) == brute_lines(awkward.collect(), 5, 2)
    assert got_lines(documents) == brute_lines(documents.collect(), 40, 5)
    assert line_bitmaps(nothing).collect() == []
    shared = " Shared line that is long enough, surely it is.\t"
    df = spark.createDataFrame([(i, f"own {i}\n{shared}\n\n{shared.upper() if i % 2 else shared}") for i in range(7)] + [(6, shared), (2, shared), (None, shared)], "doc_id long, text string")
    assert got_lines(df) == brute_lines(df.collect(), 40, 5)
    assert any(", 2, " in r for r in got_lines(df))


def test_other_columns_stay(awkward):
    out = line_bitmaps(awkward)
    assert set(awkward.columns) <= set(out.columns) and out.filter("shard = 'mine'").count() == awkward.count()
