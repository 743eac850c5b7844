"""Folders of many files: listed and read by tasks, as Spark's readers would give them."""

import gzip
from pathlib import Path

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from inkshard.sources import files, trees
from inkshard.sources.corpus import read_corpus

NAMES = ["a/b/c.txt", "top.txt", "m/x y.txt", "m/%41.txt", "m/é\xa0é .txt", "m/a+b&c=d;e,f@g$i!j'k(l)~*.txt", "m/#?[q]{}^`|\"<>.txt", "_h/x", "k=_v/_x=1/f"]
NAMES += ["m/_x", "m/.x", "m/_metadata", "_metadata/q", "m/y._COPYING_", "a/empty", "a/日本", "a/b/d/e/f", "z"]


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "odd %20 ä#x"
    for i, name in enumerate(NAMES):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"" if name == "a/empty" else b"\xef\xbb\xbf\xff" if name == "z" else f"text {i}\r\nä\0".encode())
    return root


@pytest.mark.parametrize("source_format", ["txt", "docx"])
@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_rows_are_those_of_sparks_readers(spark, folder, source_format, scheme, monkeypatch):
    rows = lambda df: sorted(map(tuple, df.withColumn("body", F.hex(F.col("body").cast("binary"))).collect()))
    ours = read_corpus(spark, f"{scheme}{folder}", source_format, nested=True)
    monkeypatch.setattr("inkshard.sources.corpus.read_tree", lambda *args: None)
    theirs = read_corpus(spark, f"{scheme}{folder}", source_format, nested=True)
    assert ours.inputFiles() == [] != theirs.inputFiles()
    assert ours.dtypes == theirs.dtypes and rows(ours) == rows(theirs) != []


def test_the_driver_holds_no_entry_for_each_document(spark, tmp_path):
    """s7_document_files: files are found by the tasks that read them."""
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(0).alias("part"), F.concat(F.lit("text "), "id").alias("text"), F.explode(F.array(F.lit("plain"), F.lit("markdown"))).alias("target_format"))
    files.write_documents(df, f"{tmp_path}/out", buckets=40)
    for target, n in ((None, 600), ("plain", 300)):
        found = files.read_documents(spark, f"{tmp_path}/out", target)
        assert found.inputFiles() == [] and found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert found.count() == n and sorted(r.text for r in found.collect()) == sorted(f"text {i}" for i in range(300) for _ in range(n // 300))


@pytest.mark.parametrize("limits", [(1, 1 << 30), (2, 1 << 30), (3, 1 << 30), (100, 20), (100, 1 << 30)])
def test_stretches_hold_each_file_once(folder, limits, monkeypatch):
    monkeypatch.setattr(trees, "STRETCH_FILES", limits[0])
    monkeypatch.setattr(trees, "STRETCH_BYTES", limits[1])
    local = fs.LocalFileSystem()
    whole = list(trees._below(local, str(folder)))
    cut = list(trees._stretches("", True, whole))
    assert [f for s in cut for f in trees._below(local, str(folder), True, s.first, s.last)] == whole and len(whole) == 12
    assert all(s.n_files <= limits[0] for s in cut) and sum(s.n_files for s in cut) == len(whole)


@pytest.mark.parametrize("change", ["more", "fewer", "longer"])
def test_files_that_change_after_they_were_listed(spark, folder, change):
    found = read_corpus(spark, str(folder), "txt", nested=True)
    assert found.count() == 12
    if change == "fewer":
        (folder / "a/b/c.txt").unlink()
    else:
        Path(folder, "a/b/c.txt" if change == "longer" else "a/b/d.txt").write_text("much longer than it was")
    with pytest.raises(Exception, match="changed after they were listed"):
        found.count()


def test_packed_texts_patterns_and_single_files(spark, folder):
    with gzip.open(folder / "a/p.gz", "wb") as f:
        f.write(b"packed")
    bodies = lambda path, fmt: [r.body for r in read_corpus(spark, path, fmt, nested=True).collect()]
    assert "packed" in bodies(str(folder), "txt") and len(bodies(str(folder), "txt")) == len(bodies(str(folder), "docx")) == 13
    assert bodies(str(folder / "a/b/c.txt"), "txt") == ["text 0\r\nä\0"] and bodies(f"{folder.parent}/*/a/p.gz", "txt") == ["packed"]


def test_a_folder_without_files(spark, tmp_path):
    assert read_corpus(spark, str(tmp_path), "txt", nested=True).collect() == []
