import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from inkshard.llm import toxicity as T
from inkshard.llm.toxicity import features, score_toxicity


def test_held_out_accuracy(spark):
    """Labels the model never saw, on the given documents."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = score_toxicity(docs, labels).join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "toxic").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    toxic, found = {r.doc_id for r in held if r.toxic}, {r.doc_id for r in held if r.predicted}
    assert len(toxic & found) / len(found) > 0.9 and len(toxic & found) / len(toxic) > 0.75
    pairs = sorted((r.score, r.toxic) for r in held)
    ranks = sum(i for i, (_, t) in enumerate(pairs) if t)
    n = len(toxic)
    assert (ranks - n * (n - 1) / 2) / (n * (len(pairs) - n)) > 0.95


def test_only_labels_that_are_not_held_out_matter(spark, awkward):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(40)], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    get = lambda df: sorted(map(str, score_toxicity(awkward, df).select("doc_id", "score").collect()))
    assert get(labels) == get(turned)


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(5, 1), (5, 1), (3, None), (None, 1), (6, 0), (99, 1), (1, 0), (7, 0), (8, 0)], "doc_id long, toxic int")
    out = score_toxicity(awkward, labels)
    assert set(awkward.columns) <= set(out.columns)
    rows = out.collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert [r.held_out for r in rows if r.doc_id is None] == [False, False]
    assert score_toxicity(nothing, labels).collect() == []
    assert {r.score for r in score_toxicity(awkward, labels.filter("false")).collect()} == {0.5}


def test_rendered_documents(spark, documents):
    labels = documents.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    assert score_toxicity(documents, labels).filter("score IS NOT NULL").count() == documents.count()


def test_features():
    assert len(features(None)) == len(features(" .,")) == 0
    assert len(features("one")) == 1 and len(features("one two three")) == 3 + 2 + 1
    assert sorted(features("One, TWO")) == sorted(features("one two"))


def plain_features(text):
    """Words, pairs and skip-pairs of one text by integers alone."""
    import xxhash

    mask = (1 << 64) - 1
    a, b, c = (int(x) for x in T._MIX)
    h = [xxhash.xxh64_intdigest(w.encode()) for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(x.lower() if x.isascii() else x for x in text or ""))]
    out = [x * a for x in h] + [((x * b & mask) ^ (y * c & mask)) * a for x, y in zip(h, h[1:])] + [((x * c & mask) ^ (y * a & mask) ^ b) * a for x, y in zip(h, h[2:])]
    return [(x & mask) >> (64 - T.BITS) for x in out]


def plain_ftrl(rows):
    """FTRL-proximal, coordinate by coordinate; the bias has the last index and no L1."""
    z, n = {}, {}

    def weight(i):
        l1 = 0 if i == 1 << T.BITS else T.L1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return (math.copysign(l1, z[i]) - z[i]) / ((T.BETA + math.sqrt(n[i])) / T.ALPHA + T.L2)

    for _ in range(T.EPOCHS):
        for found, label in rows:
            at = [*found, 1 << T.BITS]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in at:
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(before)) / T.ALPHA * w[i]
    return {i: weight(i) for i in z if weight(i)}


def test_features_of_one_text():
    for text in (None, "", "one", "One two", "Bad, BAD é words; bad words again\n"):
        assert T.features(text).tolist() == plain_features(text)


def test_weights_against_plain_ftrl():
    rng = random.Random(4)
    texts = [(" ".join(rng.choice(["foul", "vile"] if k % 3 == 0 and rng.random() < 0.4 else ["a", "b", "c", "d", "e"]) for _ in range(30)), int(k % 3 == 0)) for k in range(90)]
    rows = [(np.unique(T.features(t)), label) for t, label in texts]
    got, want = T.fit(rows), plain_ftrl([(sorted(set(plain_features(t))), label) for t, label in texts])
    assert len(want) > 5 and sorted(np.flatnonzero(got).tolist()) == sorted(want)
    assert all(math.isclose(got[i], w, rel_tol=1e-9) for i, w in want.items())
