import random

import pytest
from pyspark.sql import functions as F

WORDS = [f"w{i}" for i in range(400)]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


LONG = prose(1, 30_000)
TEXTS = [
    (5, "One fish"), (3, "one FISH"), (9, "one fish"), (7, "é Å"), (8, "É Å"), (1, None), (2, ""), (4, "   \n \n"),
    (6, LONG), (10, LONG + " end"), (11, prose(2, 80)), (12, "x " + prose(2, 80)), (12, "x " + prose(2, 80)), (12, "another text"),
    (None, "one fish"), (None, None), (13, "\n".join([prose(3, 20)] * 3)), (14, prose(3, 20)),
]

#: Names that operators give to columns of their own.
CLASHES = "n_words n_hit hit_spans hit_items shard slot size keep n_lines n_dropped kept score predicted held_out _clean _hits_0 _text_key _spans text_key prefix print rank host path rule verdict".split()


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with the names of results."""
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit("mine") for c in CLASHES}).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, shard string")


@pytest.fixture(scope="session")
def documents(spark):
    """The project's own records: pages rendered to text."""
    from inkshard.operators.render import render_pages

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(F.col("page_id").alias("doc_id"), "html")
    return render_pages(pages, "plain").cache()
