"""Fill-in-middle samples against plain slicing, and back."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkshard.llm import infill as I
from inkshard.llm.plans import op11_infill

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
HARD = [(20, "<P>"), (21, "a <S> b"), (22, "a <M"), (23, "P> b <"), (24, " lead"), (25, "trail \n"), (26, "é 😀\tü"), (27, "\x00 \x0b x"), (28, "   "), (None, "null id too")]


def brute(doc_id, text, seed=42, rate=50, spm_share=80):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    tokens = TOKEN.findall(text)
    low, high = sorted(x % (len(tokens) + 1) for x in h[:2])
    p, m, s = "".join(tokens[:low]), "".join(tokens[low:high]), "".join(tokens[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, len(tokens), "plain", None, None, text)
    if h[3] % 100 < spm_share:
        return (doc_id, len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def check(df, **options):
    rows = df.select("doc_id", "text").collect()
    out = I.infill_documents(df, **options)
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str(brute(*r, **options)) for r in rows)
    back = I.restore_documents(out).select("doc_id", "text").collect()
    assert sorted(str(tuple(r)) for r in back) == sorted(str((r.doc_id, r.text or "")) for r in rows)
    return out


def test_awkward_rows(spark, awkward, nothing):
    hard = spark.createDataFrame(HARD, "doc_id long, text string")
    for rate, share in ((50, 80), (100, 0), (100, 100), (0, 0)):
        check(awkward, rate=rate, spm_share=share)
        check(hard, rate=rate, spm_share=share)
    assert I.infill_documents(nothing).collect() == [] and I.restore_documents(I.infill_documents(nothing)).collect() == []


def test_rendered_pages(documents):
    forms = {r.form for r in check(documents).select("form").distinct().collect()}
    assert {"plain", "spm"} <= forms


def test_given_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


@pytest.mark.parametrize("block", [1, 7, 1 << 22])
def test_blocks_do_not_matter(monkeypatch, block):
    """The byte moves alone, for rows cut into blocks of any size."""
    monkeypatch.setattr(I, "BLOCK", block)
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab <>é \n"), n)) for n in rng.integers(0, 9, 60)]
    raw = [t.encode() for t in texts]
    offsets, data = np.r_[0, np.cumsum([len(r) for r in raw])], np.frombuffer(b"".join(raw), np.uint8)
    for rows in I._blocks(offsets):
        own, part = offsets[rows.start : rows.stop + 1] - offsets[rows.start], data[offsets[rows.start] : offsets[rows.stop]]
        n, cuts = I._token_cuts(own, part, [rng.integers(0, 99, len(own) - 1) for _ in range(2)])
        assert n.tolist() == [len(TOKEN.findall(t)) for t in texts[rows]]
        forms = np.where(np.diff(own) > 0, rng.integers(0, 3, len(own) - 1), 0)
        back_offsets, back = I.gather(*I.scatter(own, part, cuts, forms), forms)
        assert back_offsets.tolist() == own.tolist() and back.tobytes() == part.tobytes()


def test_marks_must_fit(spark):
    for form, output in (("psm", "<P>a<M>b"), ("spm", "<P>a<S>b<M>c")):
        with pytest.raises(Exception, match="mark"):
            I.restore_documents(spark.createDataFrame([(1, form, output)], "doc_id long, form string, output string")).collect()


def test_no_shuffle(spark):
    plan = op11_infill(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_null_samples(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, "x")], "doc_id long, form string, output string").withColumn("text", F.lit("mine"))
    assert sorted(map(tuple, I.restore_documents(df).select("doc_id", "text").collect())) == [(1, ""), (2, "x")]
