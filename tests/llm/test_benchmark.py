import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from inkshard.llm.benchmark import benchmark_hits, decontaminate
from tests.llm.conftest import prose

WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(rows, items, window=10):
    windows = defaultdict(set)
    for i in items:
        w = words_of(i.text)
        if i.item_id is not None:
            for at in range(max(1, len(w) - window + 1) if w else 0):
                windows[tuple(w[at : at + window])].add(i.item_id)
    out = []
    for r in rows:
        w, hit, ids = words_of(r.text), set(), set()
        for n in {len(k) for k in windows}:
            for at in range(len(w) - n + 1):
                if found := windows.get(tuple(w[at : at + n])):
                    hit.update(range(at, at + n))
                    ids |= found
        out.append((r.doc_id, len(w), len(hit), sorted(ids)))
    return sorted(map(str, out))


def got(df, items, **limits):
    return sorted(str(tuple(r)) for r in benchmark_hits(df, items, **limits).select("doc_id", "n_words", "n_hit", "hit_items").collect())


@pytest.fixture(scope="module")
def items(spark):
    long = prose(30, 40)
    rows = [(1, long), (2, long[5:]), (3, "One, two; three!"), (4, "two three"), (5, "eins zwei drei vier"), (6, None), (7, ""), (8, "ünï cödé 7"), (None, "never"), (3, prose(31, 12)), (9, "ha " * 15)]
    return spark.createDataFrame(rows, "item_id long, text string")


def texts(spark):
    long = prose(30, 40)
    rows = [f"start {long.upper()} stop", f"{' '.join(long.split()[3:14])}", " ".join(long.split()[:9]), "zero ONE-two three two three", "eins zwei drei", "ünï CÖDÉ 7 ünï cödé 7", "ha " * 100, f"{prose(31, 12)}, {long}"]
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


@pytest.mark.parametrize("block_words", [100_000, 30])
def test_hits(spark, awkward, items, block_words):
    for df in (texts(spark), awkward):
        assert got(df, items, block_words=block_words) == brute(df.collect(), items.collect())


def test_given_and_rendered_documents(spark, documents):
    given = [spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark")]
    for df in (given[0], documents):
        assert got(df, given[1]) == brute(df.collect(), given[1].collect())


def test_no_items_and_no_documents(awkward, nothing, items):
    assert benchmark_hits(awkward, items.filter("false")).filter("n_hit > 0").count() == 0
    assert benchmark_hits(nothing, items).collect() == []
    assert decontaminate(nothing, items).collect() == []


@pytest.mark.parametrize("block_words", [100_000, 30])
def test_passages_are_cut(spark, awkward, items, block_words):
    clean = {r.doc_id: r.text for r in decontaminate(texts(spark), items, max_coverage=0.99, block_words=block_words).collect()}
    assert clean == {0: "start  stop", 2: " ".join(prose(30, 40).split()[:9]), 3: "zero ", 4: "eins zwei drei", 5: "ünï CÖDÉ 7 "}
    assert sorted(r.doc_id for r in decontaminate(texts(spark), items).collect()) == [2, 4, 5]
    out = decontaminate(awkward, items, block_words=block_words)
    assert out.columns == awkward.columns
    assert sorted(str(tuple(r)) for r in out.collect()) == sorted(str(tuple(r)) for r in awkward.collect())


def test_spans_are_runs_of_hit_words(spark, items):
    rows = benchmark_hits(texts(spark), items).select("n_hit", F.explode("hit_spans").alias("s")).collect()
    assert rows and all(r.s.length <= r.n_hit for r in rows)
