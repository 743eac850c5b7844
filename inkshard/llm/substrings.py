"""Passages that rendered documents repeat, by suffix trees over groups of windows that share their least 16-word hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from inkshard.llm.common import fresh, larger, saved, shuffle_parts, small_batches, text_key

WINDOW = 50
#: Words of the sequences whose least hash in a window groups it.
PREFIX = 16
#: Different runs of suffixes in one subtree; a group with more goes by hashes of whole windows.
SUBTREE = 2000
#: Words whose hashes a worker remembers; words of a text worked on at a time.
REMEMBERED, BLOCK = 300_000, 1 << 19
_BASE = 0x9E3779B97F4A7C15
_hashes: dict[bytes, int] = {}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    if len(_hashes) > REMEMBERED:
        _hashes.clear()
    found = list(map(_hashes.get, words))
    for i, h in enumerate(found):
        if h is None:
            found[i] = _hashes[words[i]] = xxhash.xxh64_intdigest(words[i])
    return np.array(found, dtype=np.uint64)


def _rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Mixed polynomial hash of every n consecutive values; n is a power of two."""
    step, base = 1, np.uint64(_BASE)
    with np.errstate(over="ignore"):
        while step < n:
            h = h[:-step] * base + h[step:]
            base, step = base * base, step * 2
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def _lowest(rank: np.ndarray, n: int) -> np.ndarray:
    """The least of every n consecutive values."""
    step = 1
    while step * 2 <= n:
        rank, step = np.minimum(rank[:-step], rank[step:]), step * 2
    return np.minimum(rank[: len(rank) - (n - step)], rank[n - step :]) if step < n else rank


def _content_hashes(h: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of the values from each first to each end."""
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.full(len(h), _BASE, np.uint64))
        down = np.multiply.accumulate(np.full(len(h), pow(_BASE, -1, 1 << 64), np.uint64))
        sums = np.concatenate([[np.uint64(0)], np.add.accumulate(h * up)])
        r = (sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64)
        r = (r ^ r >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    return r ^ r >> np.uint64(29)


def suffix_runs(words: list[bytes], window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(prefix hash, leaf hash, first start, how many)``: runs of window starts that are grouped by one prefix.

    Of the 16-word sequences in a window the one with the least hash, the leftmost of equals, is its
    mark.  A window is grouped by the hash of its mark alone, which equal windows share as their
    own words alone decide on it.
    Neighbouring starts with one mark form a run, so a text has about a fourteenth as many
    runs as words.  The leaf hash is over all words of a run's windows: its 64 bits
    tell runs of one group apart.
    """
    for at in range(0, len(words) - window + 1, BLOCK):
        part = words[at : at + BLOCK + window - 1]
        hashes = _word_hashes(part)
        h = _rolling(hashes, PREFIX)
        order = np.argsort(h, kind="stable")
        rank = np.empty(len(h), np.int64)
        rank[order] = np.arange(len(h))
        mark = order[_lowest(rank, window - PREFIX + 1)]
        first = np.flatnonzero(np.diff(mark, prepend=-1))
        n = np.diff(np.r_[first, len(mark)])
        yield h[mark[first]].view(np.int64), _content_hashes(hashes, first, first + n + window - 1).view(np.int64), at + first, n


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


_RUNS = ("prefix", "leaf", "doc_id", "text_key", "first", "n")


def _runs_of(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in _RUNS]
            for doc_id, key, text in zip(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2), strict=True):
                for prefix, leaf, first, n in suffix_runs(_words(text.as_py()), window):
                    for column, value in zip(out, (prefix, leaf, np.full(len(n), doc_id), np.full(len(n), key), first, n), strict=True):
                        column.append(value)
            if out[0]:
                yield pa.record_batch(dict(zip(_RUNS, map(np.concatenate, out), strict=True)))

    return run


def _contents_of(window: int):
    """The words of runs of suffixes, from rows (doc_id, text, runs of prefix, leaf, first, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, runs in zip(*(batch.column(i) for i in range(3)), strict=True):
                words, rows = _words(text.as_py()), runs.as_py()
                yield pa.record_batch(
                    {
                        "prefix": pa.array([r["prefix"] for r in rows], pa.int64()),
                        "leaf": pa.array([r["leaf"] for r in rows], pa.int64()),
                        "doc_id": pa.array([doc_id.as_py()] * len(rows), pa.int64()),
                        "words": pa.array([b" ".join(words[r["first"] : r["first"] + r["n"] - 1 + window]) for r in rows], pa.binary()),
                    }
                )

    return run


def _windows_of(window: int):
    """Each window of the runs as its 128-bit hash: a prefix as long as it can be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for doc_id, text, runs in zip(*(batch.column(i) for i in range(3)), strict=True):
                words = _words(text.as_py())
                for r in runs.as_py():
                    for begin in range(0, r["n"], 50_000):
                        places = np.arange(begin, min(r["n"], begin + 50_000))
                        digests = b"".join(xxhash.xxh3_128_digest(b" ".join(words[s : s + window])) for s in (r["first"] + places).tolist())
                        halves = np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)
                        same = {"prefix": np.full(len(places), r["prefix"]), "leaf": np.full(len(places), r["leaf"]), "doc_id": np.full(len(places), doc_id.as_py())}
                        yield pa.record_batch({"h1": halves[:, 0].copy(), "h2": halves[:, 1].copy(), **same, "place": places})

    return run


def repeated_starts(group: np.ndarray, doc: np.ndarray, contents: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, place)`` of windows whose words also start in a row of the same group with a smaller document.

    Builds the subtrees of all groups side by side as a suffix array: the suffixes of every row,
    cut at the window's length, in sorted order.  Neighbours that agree to that depth hang below one
    deep internal node, the leaves of which are the occurrences of one repeat.
    """
    vocabulary: dict[bytes, int] = {}
    ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in c.split()], dtype=">u4") for c in contents]
    n = np.array([len(x) - window + 1 for x in ids])
    row = np.repeat(np.arange(len(ids)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    suffixes = np.empty((len(row), window + 1), dtype=">u4")
    suffixes[:, 0] = group[row]
    at = 0
    for x, k in zip(ids, n, strict=True):
        suffixes[at : at + k, 1:] = np.lib.stride_tricks.sliding_window_view(x, window)
        at += k
    leaves = suffixes.view(f"V{4 * (window + 1)}").ravel()
    order = np.argsort(leaves, kind="stable")
    same = leaves[order[1:]] == leaves[order[:-1]]
    node = np.cumsum(np.r_[True, ~same]) - 1
    docs = doc[row[order]]
    least = np.minimum.reduceat(docs, np.flatnonzero(np.r_[True, ~same])) if len(docs) else docs
    found = np.sort(order[docs > least[node]]) if len(docs) else order
    return row[found], place[found]


def _subtrees(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grown(table: pa.Table) -> pa.RecordBatch:
            prefix, leaf, doc = (table.column(c).to_numpy() for c in ("prefix", "leaf", "doc_id"))
            group = np.cumsum(np.r_[True, prefix[1:] != prefix[:-1]])
            row, place = repeated_starts(group, doc, table.column("words").to_pylist(), window)
            new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)]) if len(row) else np.empty(0, np.int64)
            n = np.diff(np.r_[new, len(row)])
            return pa.record_batch({"prefix": prefix[row[new]], "leaf": leaf[row[new]], "place": place[new], "n": n})

        rest = None
        for batch in larger(batches, 10_000):
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            prefix = table.column("prefix").to_numpy()
            if not len(prefix):
                continue
            # Runs of equal prefixes that end in this table; the last one may go on.
            ends = np.r_[np.flatnonzero(prefix[1:] != prefix[:-1]) + 1]
            done = 0
            while done < len(ends):
                cut = min(len(ends) - 1, max(done, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + 2 * SUBTREE)) - 1))
                begin = int(ends[done - 1]) if done else 0
                yield grown(table.slice(begin, int(ends[cut]) - begin))
                done = cut + 1
            rest = table.slice(int(ends[-1])) if len(ends) else table
        if rest is not None and rest.num_rows:
            yield grown(rest)

    return run


def repeated_spans(documents: DataFrame, window: int = WINDOW, subtree: int = SUBTREE) -> DataFrame:
    """``(doc_id, text_key, start, length)``: word spans covered by windows that start in a smaller doc_id too.

    ``documents`` has ``doc_id, text_key, text``.  Spans of a document may overlap.  See ``drop_repeats`` for the terms.
    """
    parts = shuffle_parts(small_batches(documents))
    known = documents.filter("doc_id IS NOT NULL").select("doc_id", "text_key", "text")
    runs = known.mapInArrow(_runs_of(window), ", ".join(f"{c} long" for c in _RUNS))
    # Equal runs are one leaf, whose smallest document stands for all of them.  Saved, as two branches read it.
    leaves = saved(runs.groupBy("prefix", "leaf").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")))
    nodes = leaves.groupBy("prefix").agg(F.min("least").alias("lo"), F.max("most").alias("hi"), F.count(F.lit(1)).alias("leaves")).filter("lo < hi")
    shared = leaves.join(nodes, "prefix").select("prefix", "leaf", "least", "leaves")
    found = saved(runs.join(shared, ["prefix", "leaf"]))

    whole = found.filter("doc_id > least").select("doc_id", "text_key", F.col("first").alias("start"), (F.col("n") + window - 1).alias("length"))
    # Different leaves under one prefix: what they share is inside them.
    open_runs = found.filter("doc_id = least AND leaves > 1")
    at = F.min(F.struct("text_key", "first", "n", (F.col("leaves") > subtree).alias("large"))).alias("at")
    run = F.struct("prefix", "leaf", "at.first", "at.n")
    one = open_runs.groupBy("prefix", "leaf", "doc_id").agg(at).select("doc_id", F.col("at.text_key").alias("text_key"), "at.large", run.alias("run"))
    one = one.groupBy("doc_id", "text_key").agg(F.collect_list(F.when(~F.col("large"), F.col("run"))).alias("small"), F.collect_list(F.when(F.col("large"), F.col("run"))).alias("large"))
    held = documents.join(one, ["doc_id", "text_key"])

    contents = held.filter(F.size("small") > 0).select("doc_id", "text", "small").mapInArrow(_contents_of(window), "prefix long, leaf long, doc_id long, words binary")
    sorted_runs = contents.repartition(parts, "prefix").sortWithinPartitions("prefix")
    inside = sorted_runs.mapInArrow(_subtrees(window), "prefix long, leaf long, place long, n long")

    windows = held.filter(F.size("large") > 0).select("doc_id", "text", "large").mapInArrow(_windows_of(window), "h1 long, h2 long, prefix long, leaf long, doc_id long, place long")
    first = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"))
    single = windows.join(first, ["h1", "h2"]).filter("doc_id > least").select("prefix", "leaf", "place", F.lit(1).cast("long").alias("n"))

    inner = open_runs.select("prefix", "leaf", "doc_id", "text_key", "first").join(inside.unionByName(single), ["prefix", "leaf"])
    inner = inner.select("doc_id", "text_key", (F.col("first") + F.col("place")).alias("start"), (F.col("n") + window - 1).alias("length"))
    return whole.unionByName(inner)


_KEPT = StructType([StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])


@F.arrow_udf(_KEPT)
def _keep(texts: pa.Array, spans: pa.Array) -> pa.Array:
    n_words, n_removed, kept = [], [], []
    for text, own in zip(texts, spans, strict=True):
        words = _words(text.as_py())
        edge = np.zeros(len(words) + 1, np.int64)
        for s in own.as_py() or ():
            edge[s["start"]] += 1
            edge[s["start"] + s["length"]] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        n_words.append(len(words))
        n_removed.append(int(gone.sum()))
        kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if n_removed[-1] else words))
    return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["n_words", "n_removed", "kept"])


def drop_repeats(documents: DataFrame, window: int = WINDOW, subtree: int = SUBTREE) -> DataFrame:
    """``documents`` with ``n_words, n_removed`` and the text without repeated passages.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  Each word goes that is covered by ``window``
    consecutive words which also start in a document with a smaller doc_id; windows are judged on the
    input.  The text becomes the kept words joined by single spaces.

    Null and empty texts have no words and come out empty.  Rows that repeat a doc_id are one
    document and do not repeat each other; rows with a null doc_id lose nothing and are no one's
    example.  Columns that bear the names of new ones are replaced, all others kept.

    A window belongs to the group of its least 16-word hash, wherever in it that stands (``suffix_runs``).
    Only groups that two documents share are followed up.  Runs of suffixes with the same 64-bit leaf hash are one leaf, so a
    passage that a third of all documents hold shrinks to a row for each task, and all but its smallest
    document are settled.  Different leaves of a group meet in a subtree of at most ``subtree`` leaves,
    whose internal nodes of depth ``window`` are the repeats.  Groups with more leaves go by 128-bit
    hashes of whole windows, where a node needs no more than its smallest document, again
    combined map-side.  Whole texts are shuffled by document and meet their runs and spans there.
    """
    key, start = fresh(documents, "_text_key", "_spans")
    rows = documents.withColumn(key, text_key(F.col("text"))).repartition(shuffle_parts(documents), "doc_id", key)
    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    spans = repeated_spans(plain, window, subtree).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "length")).alias(start))
    spans = spans.select(F.col("doc_id").alias(key + "_doc"), F.col("text_key").alias(key + "_key"), start)
    out = rows.join(spans, (F.col("doc_id") == F.col(key + "_doc")) & (F.col(key) == F.col(key + "_key")), "left")
    out = out.withColumn(start, _keep(F.col("text"), F.col(start)))
    out = out.withColumns({"n_words": F.col(f"{start}.n_words"), "n_removed": F.col(f"{start}.n_removed"), "text": F.col(f"{start}.kept")})
    return out.drop(key, key + "_doc", key + "_key", start)
