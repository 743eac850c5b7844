"""One named file for each document and target."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from inkshard.sources import files

SCHEMA = "doc_id string, part long, text string, target_format string"


def found(spark, path):
    return sorted(map(tuple, files.read_documents(spark, path).collect()))


def test_named_files_and_replay(spark, tmp_path):
    rows = [("7", 1, "b\nä", "plain"), ("7", 0, "a", "plain"), ("7", 0, "*a*", "markdown"), ("x/y 1", 0, "z", "plain"), (None, 0, None, "plain"), ("8", 0, "eight", "fb2")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit(1)).repartition(4)
    out = f"{tmp_path}/out"
    want = sorted([("7", "plain", "converted-document.txt", "ab\nä"), ("7", "markdown", "converted-document.md", "*a*"), ("x/y 1", "plain", "converted-document.txt", "z"), ("8", "fb2", "converted-document.docx", "eight")])
    for _ in range(2):
        files.write_documents(df, out)
        assert found(spark, out) == want
    # By name alone; an empty document is a file, though no reader makes a row of it.
    at = lambda doc: spark.range(1).select(files.file_of(F.lit(doc), F.lit("plain"))).first()[0]
    assert Path(out, at("7")).read_text() == "ab\nä" and Path(out, at(None)).read_text() == ""
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_a_failed_write_leaves_the_old_files(spark, tmp_path):
    out = f"{tmp_path}/out"
    good = spark.createDataFrame([("1", 0, "old", "plain")], SCHEMA)
    files.write_documents(good, out)
    bad = spark.range(50).select(F.col("id").cast("string").alias("doc_id"), F.lit(0).alias("part"), F.lit("plain").alias("target_format"), F.when(F.col("id") == 37, F.raise_error(F.lit("boom"))).otherwise(F.lit("new")).alias("text"))
    with pytest.raises(Exception, match="boom"):
        files.write_documents(bad, out)
    assert [r[3] for r in found(spark, out)] == ["old"] and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_an_empty_table(spark, tmp_path):
    files.write_documents(spark.createDataFrame([], SCHEMA), f"{tmp_path}/out")
    assert list(Path(tmp_path, "out").iterdir()) == []


def test_folders_are_listed_by_buckets(spark, tmp_path):
    """No task for each file, and no pattern expanded on the driver; names that readers would hide are found."""
    ids = [".", "..", "_x", ".x._COPYING_", *map(str, range(200))]
    df = spark.createDataFrame([(i, 0, f"text {i}", t) for i in ids for t in ("plain", "markdown")], SCHEMA)
    files.write_documents(df, f"{tmp_path}/out", buckets=40)
    spark.sparkContext.setJobGroup("listing", "")
    try:
        both, one = files.read_documents(spark, f"{tmp_path}/out"), files.read_documents(spark, f"{tmp_path}/out", "plain")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("listing")]
    assert len(jobs) == 2 and all(tracker.getStageInfo(s).numTasks <= 40 for j in jobs for s in j.stageIds)
    assert sorted(r[0] for r in one.collect()) == sorted(ids) and {r[1] for r in one.collect()} == {"plain"}
    assert sorted((r[0], r[3]) for r in both.collect()) == sorted((i, f"text {i}") for i in ids for _ in range(2))


def test_pages_as_files_are_listed_by_buckets(spark):
    """s1_read_corpus_files: folders of buckets are listed, not a task or pattern for each page."""
    from inkshard.plans import PLANS

    sf = "/root/testdata/sf0.01"
    spark.sparkContext.setJobGroup("pages", "")
    try:
        found = PLANS["s1_read_corpus_files"].build(spark, sf)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    pages, tracker = spark.read.parquet(f"{sf}/pages.parquet").filter("html <> ''").count(), spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("pages") for s in tracker.getJobInfo(j).stageIds]
    assert found.count() == pages and max(tasks) < pages
