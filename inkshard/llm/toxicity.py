"""Toxicity of rendered documents: FTRL-proximal logistic regression over hashed word n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from inkshard.llm.benchmark import item_words
from inkshard.llm.common import small_batches

#: The bounded sample a model is fitted on: about this many labelled rows, thinned out by a hash of doc_id ...
SAMPLE_ROWS = 12_000
#: ... and of those, in hash order, as many as have this many features together (120 MB).
SAMPLE_FEATURES = 30_000_000
BITS = 18
EPOCHS, ALPHA, BETA, L1, L2 = 3, 1.0, 1.0, 10.0, 0.1
THRESHOLD = 0.3
#: Words whose hashes a worker remembers.
REMEMBERED = 100_000
_SIZE = 1 << BITS
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_hashes: dict[bytes, int] = {}


def features(text: str | None) -> np.ndarray:
    """Hashed features of a whole text, with repeats: words, pairs of neighbours, pairs with one word between."""
    import xxhash

    words = item_words(text)
    if len(_hashes) > REMEMBERED:
        _hashes.clear()
    found = list(map(_hashes.get, words))
    for i, h in enumerate(found):
        if h is None:
            found[i] = _hashes[words[i]] = xxhash.xxh64_intdigest(words[i])
    h = np.array(found, dtype=np.uint64)
    with np.errstate(over="ignore"):
        one = h * _MIX[0]
        two = (h[:-1] * _MIX[1]) ^ (h[1:] * _MIX[2])
        skip = (h[:-2] * _MIX[2]) ^ (h[2:] * _MIX[0]) ^ _MIX[1]
        return (np.concatenate([one, two * _MIX[0], skip * _MIX[0]]) >> np.uint64(64 - BITS)).astype(np.int64)


def fit(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights of rows (distinct features, label); the last is the bias, which pays no L1."""
    z, n = np.zeros(_SIZE + 1), np.zeros(_SIZE + 1)
    l1 = np.full(_SIZE + 1, L1)
    l1[-1] = 0

    def weights(at=slice(None)):
        return np.where(np.abs(z[at]) <= l1[at], 0.0, (np.sign(z[at]) * l1[at] - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for found, label in rows:
            at = np.append(found, _SIZE)
            w = weights(at)
            g = _sigmoid(w.sum()) - label
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights()


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def _distinct_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(features(t.as_py())).astype(np.int32) for t in batch.column(1)]
        yield pa.record_batch({"key": batch.column(0), "found": pa.array(found, pa.list_(pa.int32())), "label": batch.column(2)})


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, room = [], SAMPLE_FEATURES
    for batch in batches:
        for found, label in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            room -= len(found)
            if room >= 0 or not rows:
                rows.append((found.values.to_numpy(), label))
    if rows:
        w = fit(rows)
        at = np.flatnonzero(w)
        yield pa.record_batch({"feature": at, "weight": w[at]})
    # The worker lives on; the sample's memory need not.
    del rows
    pa.default_memory_pool().release_unused()


def is_held_out(doc_id: Column) -> Column:
    """A quarter of the documents, whose labels no model sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_toxicity(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and weights of a model of ``labels.toxic``, learnt from documents that are not held out.

    About ``sample_rows`` labelled rows are taken by a hash of doc_id (all, where there are no more).  Their ids
    are broadcast, so documents are read once and not shuffled; features are made where the
    documents lie, and one task fits the bounded sample, in hash order, with per-coordinate
    rates and L1.  The model is 2**18 + 1 numbers at most, nearly all zero and left out.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label"))
    place = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_000))
    n = known.count()
    if n > sample_rows:
        known = known.filter(place < 1_000_000 * sample_rows // n)
    chosen = documents.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("id"))
    rows = chosen.select(F.xxhash64("id").alias("key"), "text", "label").mapInArrow(_distinct_features, "key long, found array<int>, label int")
    fitted = rows.repartition(1).sortWithinPartitions("key", "label", F.size("found")).mapInArrow(_fit, "feature long, weight double").toPandas()
    return fitted["feature"].to_numpy(np.int64), fitted["weight"].to_numpy(np.float64)


def _scores(model) -> Callable[[Column], Column]:
    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        at, w = model.value
        dense = np.zeros(_SIZE + 1, np.float32)
        dense[at] = w
        out = []
        for text in texts:
            found = features(text.as_py())
            found = np.unique(found[dense[found] != 0])
            out.append(_sigmoid(float(dense[found].sum(dtype=np.float64) + dense[-1])))
        return pa.array(out, pa.float64())

    # Not to be evaluated once more for a filter.
    return score.asNondeterministic()


def score_toxicity(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` with ``held_out``, ``score`` (0 to 1, toxic likelier when higher) and ``predicted`` (1 from ``threshold`` up).

    The model is fitted by ``fit_toxicity`` on ``labels`` ``(doc_id, toxic)`` and sees the text of a document
    alone; every document is scored by its whole text.  Null and empty texts get the bias's
    score.  Null labels and labels of unknown or null ids are ignored, a doc_id labelled twice counts
    twice, and with no label at all every score is 0.5.  Columns that bear the names of new ones are
    replaced, all others kept.
    """
    model = small_batches(documents).sparkSession.sparkContext.broadcast(fit_toxicity(documents, labels, sample_rows))
    scored = documents.withColumn("held_out", is_held_out(F.col("doc_id"))).withColumn("score", _scores(model)(F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
