"""A corpus of documents made ready for training, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkshard.llm.benchmark import decontaminate
from inkshard.llm.common import saved, set_aside
from inkshard.llm.lines import apply_keep, line_bitmaps
from inkshard.llm.packing import pack_documents
from inkshard.llm.similar import drop_similar
from inkshard.llm.toxicity import score_toxicity

#: A classifier, fingerprints by XXH64 and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None

#: Words whose ids a worker of the packing stage remembers: its workers hold the tables of the earlier stages as well.
REMEMBERED = 150_000


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text where there is such a column."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, all columns as they are.

    Null and empty texts are scored like others; repeated rows share one verdict; no documents give none.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    plain, back = set_aside(docs, "held_out", "score", "predicted")
    return score_toxicity(plain, labels).filter("predicted = 0").select(*plain.columns).withColumnsRenamed(back)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many of them share.

    Null and empty texts stay as they are; rows with a null doc_id lose nothing; rows that repeat a doc_id are one document
    (of equal lines the largest doc_id keeps its own); other columns stay, ``n_chars`` follows.
    """
    plain, back = set_aside(docs, "n_lines", "n_dropped", "keep")
    kept = F.when(F.col("n_dropped") > 0, apply_keep(F.col("text"), F.col("keep"))).otherwise(F.col("text"))
    return _measured(line_bitmaps(plain).withColumn("text", kept).select(*plain.columns).withColumnsRenamed(back))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each group of near copies (five-word shingles, similarity 0.8 and more): the smallest doc_id's.

    SimHash fingerprints within 4 bits propose, MinHash bands add what lies further apart, and shingles decide.
    Texts without words are copies of each other; a null doc_id comes after all others; see ``drop_similar``.
    """
    return drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of test items; those that are little else go.

    Null and empty texts have no words and stay; rows are judged one by one, repeated ones alike; ``n_chars`` follows.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _measured(decontaminate(docs, items))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the token sequences.

    Null texts are empty documents of one id; repeated rows are placed one by one; no documents give no pieces.
    """
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), remember=REMEMBERED)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; what a stage keeps is saved before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs)
    return docs
