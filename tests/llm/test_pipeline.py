"""The stages against plain Python, each on what its predecessor kept."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from inkshard.llm.toxicity import score_toxicity
from tests.llm.conftest import CLASHES
from tests.llm.test_benchmark import brute as brute_hits
from tests.llm.test_exact_and_lines import brute_lines
from tests.llm.test_packing import packed
from tests.llm.test_similar import brute_labels

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, stage) in enumerate(P.STAGES):
        kept = stage(spark, docs, SF)
        kept.write.parquet(str(folder / str(i)))
        out.append((docs, docs := spark.read.parquet(str(folder / str(i)))))
    return out


def test_columns_stay(stages):
    assert all(after.columns == before.columns for before, after in stages[:-1])
    assert all(after.filter("n_chars <> char_length(text)").count() == 0 for _, after in stages[:-1])


def test_toxicity(spark, stages):
    before, after = stages[0]
    gone = score_toxicity(before, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1")
    assert gone.count() and sorted(map(str, before.join(gone, "doc_id", "left_anti").select(before.columns).collect())) == sorted(map(str, after.collect()))


def test_lines(stages):
    before, after = stages[1]
    want = sorted(x.split(", ", 1)[0] + x.split(", ", 3)[3] for x in brute_lines(before.collect(), 40, 5))
    assert want == sorted(f"({r.doc_id}{str((r.text,))[1:-2]})" for r in after.collect())


def test_near_copies(stages):
    before, after = stages[2]
    rows = sorted(before.collect(), key=lambda r: r.doc_id)
    first = {rows[i].doc_id for i in brute_labels([r.text for r in rows])}
    assert {r.doc_id for r in after.collect()} == first and after.count() == len(first) < len(rows)


def test_test_items_are_gone(spark, stages):
    before, after = stages[3]
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    count = lambda df: sum(eval(r)[2] > 0 for r in brute_hits(df.collect(), items))  # noqa: E731, S307
    assert count(before) and not count(after)
    untouched = {eval(r)[0] for r in brute_hits(before.collect(), items) if eval(r)[2] == 0}  # noqa: S307
    texts = {r.doc_id: r.text for r in after.collect()}
    assert all(texts[r.doc_id] == r.text for r in before.collect() if r.doc_id in untouched)


def test_packing(spark, stages):
    import public_tokenizers

    before, after = stages[4]
    rows, n = packed(before, 2048)
    assert after.select("sequence_id").distinct().count() == n and after.agg(F.sum("length")).first()[0] == sum(r.length for r in rows)
    assert public_tokenizers.path("word_bpe_49k.json")


def test_run_gives_the_same_pieces(spark, stages):
    pieces = lambda df: sorted(map(tuple, df.select("doc_id", "piece", "ids_crc32").collect()))
    assert pieces(P.run(spark, SF)) == pieces(stages[-1][1])


@pytest.mark.parametrize("name, stage", P.STAGES[:-1])
def test_stages_take_awkward_documents(spark, awkward, nothing, name, stage):
    out = stage(spark, awkward, SF)
    assert out.columns == awkward.columns
    rows = out.collect()
    assert rows and all(r[c] == "mine" for r in rows for c in CLASHES)
    assert stage(spark, nothing, SF).collect() == []


def test_packing_takes_awkward_documents(spark, awkward, nothing):
    assert P.packing(spark, awkward, SF).select("doc_id").distinct().count() == awkward.select("doc_id").distinct().count()
    assert P.packing(spark, nothing, SF).collect() == []
