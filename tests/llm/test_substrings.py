import pytest

from inkshard.llm.substrings import drop_repeats, suffix_runs
from tests.llm.conftest import prose


def brute(rows, window):
    words = [(r.text or "").encode().split() for r in rows]
    first = {}
    for r, w in zip(rows, words, strict=True):
        if r.doc_id is not None:
            for i in range(len(w) - window + 1):
                key = b" ".join(w[i : i + window])
                first[key] = min(first.get(key, r.doc_id), r.doc_id)
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = set()
        if r.doc_id is not None:
            for i in range(len(w) - window + 1):
                if first[b" ".join(w[i : i + window])] < r.doc_id:
                    gone.update(range(i, i + window))
        out.append((r.doc_id, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(map(str, out))


def got(df, **limits):
    return sorted(str(tuple(r)) for r in drop_repeats(df, **limits).select("doc_id", "n_words", "n_removed", "text").collect())


@pytest.mark.parametrize("subtree", [2000, 1])
def test_awkward_rows(awkward, nothing, subtree):
    want = brute(awkward.collect(), 50)
    assert got(awkward, subtree=subtree) == want and any(", 30000, " in r for r in want)
    assert drop_repeats(nothing).collect() == []


@pytest.mark.parametrize("subtree", [2000, 2])
def test_shared_passages(spark, subtree):
    """Passages at the edge of the window, overlapping, inside one document, and periodic text."""
    a, b = prose(10, 50), prose(11, 120)
    texts = [a, f"x {a} y", f"{a[1:]}", f"{b} {a} {b}", f"{b[10:]} end", prose(12, 49) + " " + a, "ha " * 400, "ha " * 90, f"{a} {prose(13, 30)} {a}", b.upper()]
    df = spark.createDataFrame(list(enumerate(texts)) + [(1, b), (4, texts[4]), (None, b)], "doc_id long, text string")
    assert got(df, subtree=subtree) == brute(df.collect(), 50)
    assert got(df, window=16, subtree=subtree) == brute(df.collect(), 16)


def test_given_and_rendered_documents(spark, documents):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(given) == brute(given.collect(), 50)
    assert got(documents) == brute(documents.collect(), 50)


def test_equal_windows_meet_whatever_surrounds_them():
    shared = prose(20, 50).split()
    keys = set()
    for i in range(30):
        words = [w.encode() for w in prose(100 + i, 30).split() + shared + prose(200 + i, 30).split()]
        for prefix, _, first, n in suffix_runs(words):
            for p, f, k in zip(prefix, first, n, strict=True):
                if f <= 30 < f + k:
                    keys.add(int(p))
    assert len(keys) == 1


def test_other_columns_stay(awkward):
    out = drop_repeats(awkward)
    assert set(awkward.columns) <= set(out.columns) and out.filter("shard = 'mine'").count() == awkward.count()
