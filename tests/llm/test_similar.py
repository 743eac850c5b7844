"""Near copies by five-word shingles against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from inkshard.llm import similar as S
from tests.llm.conftest import prose


def brute_sets(texts):
    words = ["".join(c.lower() if c.isascii() else c for c in t or "").encode().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in words]


def brute_labels(texts):
    """The first row reachable over pairs with 4 of 5 shingles in common."""
    sets, label = brute_sets(texts), list(range(len(texts)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i in range(len(sets)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small * 5 >= large * 4 and (n := len(sets[i] & sets[j])) * 5 >= 4 * (small + large - n) and find(i) != find(j):
                label[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def edited(text, share, seed):
    rng, words = random.Random(seed), text.split()
    for i in rng.sample(range(len(words)), round(len(words) * share)):
        words[i] = f"new{rng.random()}"
    return " ".join(words)


def check(df):
    rows = df.collect()
    got = sorted((str(r.doc_id), r.component) for r in S.similar_copies(df).collect())
    order = sorted(range(len(rows)), key=lambda i: str(rows[i].doc_id))
    want = brute_labels([rows[i].text for i in order])
    assert len(got) == len(want)
    return got, [(str(rows[i].doc_id), w) for i, w in zip(order, want, strict=True)]


def groups(pairs):
    out = {}
    for doc, label in pairs:
        out.setdefault(label, []).append(doc)
    return sorted(map(sorted, out.values()))


def test_given_documents(spark):
    got, want = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    assert groups(got) == groups(want) and len(groups(got)) < len(got)


def test_awkward_rows(awkward, nothing):
    got, want = check(awkward.select("doc_id", "text"))
    assert groups(got) == groups(want)
    assert S.similar_copies(nothing).collect() == []


def test_edited_copies(spark):
    """A group around one text, where members are near copies over others only, and pairs on both sides of the limit."""
    texts = [edited(prose(50, 300), 0.012 * (k % 3), k) for k in range(60)]
    texts += [t for k in range(60, 100) for t in (prose(k, 120), edited(prose(k, 120), 0.005 * (k % 9), k))]
    got, want = check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert groups(got) == groups(want)


@pytest.mark.parametrize("seed", range(3))
def test_bands_of_near_copies_meet(seed):
    """At the least share of common shingles: 800 of 1,000, with 100 on each side alone."""
    h = np.random.default_rng(seed).integers(0, 1 << 63, (300, 1125), dtype=np.uint64)
    both = [(S.band_keys(np.sort(x[:900])), S.band_keys(np.sort(np.r_[x[:800], x[900:1000]]))) for x in h]
    assert sum((a == b).any() for a, b in both) >= 298


def test_stage_drops_copies_that_differ_in_a_few_words(spark):
    """One word in a hundred replaced: most of these are further apart than 4 bits of a fingerprint."""
    texts = {k: prose(k, 200) for k in range(20)}
    texts |= {100 + k: edited(texts[k], 0.01, k) for k in range(20)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in P.simhash_dedup(spark, df, "").collect()) == list(range(20))


def test_stage_keeps_one_row_of_each_group(spark):
    """Repeated ids with unrelated texts, repeated rows and null ids."""
    a, b, c, d = (prose(k, 200) for k in range(4))
    rows = [(1, a), (2, edited(a, 0.01, 1)), (2, b), (3, c), (3, c), (None, edited(c, 0.01, 2)), (None, d), (None, edited(d, 0.01, 3)), (None, d), (4, None), (5, " ")]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, _text_key string").repartition(3)
    out = P.simhash_dedup(spark, df, "")
    got = [tuple(r) for r in out.collect()]
    assert out.columns == df.columns and all(r[2] == "mine" for r in got)
    (last,) = [r[1] for r in got if r[0] is None]
    assert last in (d, edited(d, 0.01, 3))
    assert sorted(r[:2] for r in got if r[0] is not None and r[0] < 4) == sorted([(1, a), (2, b), (3, c)]) and [r[:2] for r in got if r[0] == 4] == [(4, None)]
    assert len(got) == 5


def passage_set(n, common, own):
    """Texts of one common passage and words of their own, none a near copy of another."""
    passage = prose(1, common)
    return [f"{passage} " + " ".join(f"o{k}x{i}" for i in range(own)) for k in range(n)]


@pytest.mark.parametrize("own, share", [(28, 0.58), (14, 0.74), (11, 0.79)])
def test_texts_around_one_passage_meet_nobody(spark, own, share):
    """Pairs to be decided grow with the texts, not with their square."""
    sets = [set(S.shingles(t).tolist()) for t in passage_set(2, 80, own)]
    assert abs(len(sets[0] & sets[1]) / len(sets[0] | sets[1]) - share) < 0.05
    for n in (200, 400):
        rows = [(k, 7 * k, [int(h) for h in S.shingles(t).view(np.int64)], bytearray(S.sketch(S.shingles(t)))) for k, t in enumerate(passage_set(n, 80, own))]
        df = spark.createDataFrame(rows, "node long, root long, shingles array<long>, sketch binary").withColumn("n", F.size("shingles"))
        assert S._prefix_pairs(df.select("node", "root"), df.select("node", "n", "shingles", "sketch")).distinct().count() == 0
    df = spark.createDataFrame(list(enumerate(passage_set(60, 80, own))), "doc_id long, text string")
    assert S.similar_copies(df).select("component").distinct().count() == 60


@pytest.mark.parametrize("seed", range(4))
def test_prefix_filter_misses_no_near_copy(spark, seed):
    """Sets of all sizes from a few values, against all pairs; equal roots never meet."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 40, 60)
    sets = {k: np.unique(np.r_[base[rng.random(60) < 0.9][: rng.integers(3, 60)], rng.integers(0, 1 << 40, rng.integers(0, 6))]) for k in range(150)}
    rows = [(k, k // 3, [int(x) for x in v], bytearray(S.sketch(v.astype(np.uint64)))) for k, v in sets.items()]
    df = spark.createDataFrame(rows, "node long, root long, shingles array<long>, sketch binary").withColumn("n", F.size("shingles"))
    got = {tuple(r) for r in S._prefix_pairs(df.select("node", "root"), df.select("node", "n", "shingles", "sketch")).collect()}
    want = {(a, b) for a in sets for b in sets if b < a and a // 3 != b // 3 and S.similar(sets[a], sets[b])}
    assert want and want <= got and all(a // 3 != b // 3 for a, b in got)


def batches(columns, size):
    rows = list(zip(*columns.values(), strict=True))
    return [pa.record_batch([pa.array(c) for c in zip(*rows[i : i + size], strict=True)], list(columns)) for i in range(0, len(rows), size)]


@pytest.mark.parametrize("size", [1, 3, 100])
def test_buckets_over_batches(monkeypatch, size):
    monkeypatch.setattr(S, "larger", lambda b: b)
    key = np.array([1, 2, 2, 2, 2, 3, 4, 4, 5])
    columns = {"key": key, "node": np.arange(9), "n": np.array([5, 5, 5, 9, 5, 5, 5, 5, 5])}
    met = [r["node"] for b in S._met(batches(columns, size)) for r in b.to_pylist()]
    assert met == [1, 2, 3, 4, 6, 7]
    pairs = [(r["a"], r["b"]) for b in S._hub_pairs(batches(columns, size)) for r in b.to_pylist()]
    assert pairs == [(2, 1), (4, 1), (7, 6)]


def test_rendered_pages(documents):
    """The project's own records: no page is a near copy of another but of itself, with a few words changed."""
    pages = documents.filter("length(text) > 400").select("doc_id", "text")
    copies = pages.select((F.col("doc_id") + 1000).alias("doc_id"), F.concat(F.lit("Printed "), "text").alias("text"))
    got, want = check(pages.unionByName(copies))
    assert groups(got) == groups(want) and len(groups(got)) <= pages.count()


def test_copies_of_one_text_far_from_each_other(spark):
    """A group around a text whose members are mostly under the limit: no more pairs come to be decided than are near."""
    sets = {k: S.shingles(edited(prose(5, 150), 0.04 + 0.001 * (k % 9), k)) for k in range(150)}
    rows = [(k, k, [int(x) for x in v.view(np.int64)], bytearray(S.sketch(v))) for k, v in sets.items()]
    df = spark.createDataFrame(rows, "node long, root long, shingles array<long>, sketch binary").withColumn("n", F.size("shingles"))
    got = {tuple(r) for r in S._prefix_pairs(df.select("node", "root"), df.drop("root")).collect()}
    want = {(a, b) for a in sets for b in range(a) if S.similar(sets[a], sets[b])}
    assert want <= got and len(got) < len(want) + 150


def test_fingerprints_propose_without_bands(spark, monkeypatch):
    """Long texts with one word replaced lie within 4 bits; equal fingerprints of other texts and short texts are decided by words."""

    def none(batches):
        for _ in batches:
            yield pa.record_batch({"key": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "n": pa.array([], pa.int32())})

    texts = {k: prose(k, 4000) for k in range(6)}
    texts |= {100 + k: edited(texts[k], 1 / 4000, k) for k in range(6)}
    texts |= {200: "a b c", 201: "c b a", 202: "A  b c"}
    assert all((S.fingerprint(texts[k]) ^ S.fingerprint(texts[100 + k])).bit_count() <= 4 for k in range(6))
    monkeypatch.setattr(S, "_met", none)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in P.simhash_dedup(spark, df, "").collect()) == [*range(6), 200, 201]


def test_pairs_of_fingerprints(spark):
    """Equal ones meet their first, ones within 4 bits by their first, others not."""
    rows = [(1, 50, 0), (2, 50, 0), (3, 90, 0), (4, 50, 0b1111), (5, 50, (1 << 40) - 1)]
    got = S._print_pairs(spark.createDataFrame(rows, "node long, n int, print long")).collect()
    assert sorted(tuple(sorted(r)) for r in got) == [(1, 2), (1, 4)]
