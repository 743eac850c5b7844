"""Near copies by the share of word shingles they have in common: SimHash fingerprints and MinHash bands propose, shingles decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from inkshard.llm.common import ASCII_LOWER, SPACE, ascii_lower, fresh, larger, saved, shuffle_parts, small_batches, text_key
from inkshard.llm.simhash import components, fingerprint, print_links
from inkshard.llm.substrings import _word_hashes

#: Words of a shingle, and the least share (as a fraction of integers) of common shingles in all shingles of two near copies.
SHINGLE, LEAST = 5, (4, 5)
#: Two texts at the least share miss each other in every band with probability (1 - 0.8 ** 6) ** 30, about 1e-4.
BAND_ROWS, BANDS, SEED = 6, 30, 42
#: 64-bit words of the sketch that bounds how many shingles two sets have in common.
SKETCH = 8
#: Shingles hashed at a time; pairs of a batch.
BLOCK, PAIRS = 2048, 50_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(SEED)
_TIMES = _rng.integers(0, 1 << 64, BAND_ROWS * BANDS, dtype=np.uint64) | np.uint64(1)
_PLUS = _rng.integers(0, 1 << 64, BAND_ROWS * BANDS, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the different ``n``-word shingles, A-Z lower-cased; a text under ``n`` words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if len(words) < n:
        return np.empty(0, np.uint64)
    h = _word_hashes(words)
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * _BASE + h[i : len(h) - n + 1 + i]
    return np.unique(_mixed(out))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of the MinHash signature."""
    if not len(hashes):
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        least = np.min([(hashes[at : at + BLOCK, None] * _TIMES + _PLUS).min(axis=0) for at in range(0, len(hashes), BLOCK)], axis=0)
        out = np.arange(BANDS, dtype=np.uint64)
        for column in _mixed(least).reshape(BANDS, BAND_ROWS).T:
            out = _mixed(out * _BASE + column)
    return out.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * LEAST[1] >= LEAST[0] * (len(a) + len(b) - common)


@F.arrow_udf(StructType([StructField("n", IntegerType()), StructField("keys", ArrayType(LongType())), StructField("print", LongType())]))
def _signature(texts: pa.Array) -> pa.Array:
    """Number of different shingles, the band keys, and the SimHash fingerprint."""
    texts = [t.as_py() for t in texts]
    sets = [shingles(t) for t in texts]
    keys = pa.array([band_keys(h) for h in sets], pa.list_(pa.int64()))
    return pa.StructArray.from_arrays([pa.array([len(h) for h in sets], pa.int32()), keys, pa.array(map(fingerprint, texts), pa.int64())], ["n", "keys", "print"])


def _node(text: Column) -> Column:
    """64 bits that tell apart texts with different words."""
    return F.xxhash64(F.lit("words"), F.btrim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), f"[{SPACE}]+", " ")))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of buckets with several members, from rows sorted by key; of a bucket only the last row is carried on."""
    names, last, seen = ["key", "node", "n"], None, False
    for batch in larger(batches):
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if last is not None:
            rows = [np.r_[x, y] for x, y in zip(last, rows, strict=True)]
        same = rows[0][1:] == rows[0][:-1]
        many = np.r_[same, False] | np.r_[seen, same]
        last, seen = [c[-1:] for c in rows], bool(many[-1])
        yield pa.record_batch([pa.array(c[:-1][many[:-1]]) for c in rows], names)
    if seen:
        yield pa.record_batch([pa.array(c) for c in last], names)


def may_be_similar(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can have the least share."""
    return np.minimum(n, m) * LEAST[1] >= np.maximum(n, m) * LEAST[0]


def _hub_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each member of a bucket with the bucket's first, if their sizes allow; from rows sorted by key."""
    hub = None
    for batch in larger(batches):
        keys, nodes, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(keys):
            continue
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        first, size = nodes[starts].copy(), n[starts].copy()
        if hub and keys[0] == hub[0]:
            first[0], size[0] = hub[1:]
        hub = (keys[-1], first[-1], size[-1])
        runs = np.diff(np.r_[starts, len(keys)])
        first, size = np.repeat(first, runs), np.repeat(size, runs)
        keep = (nodes != first) & may_be_similar(n, size)
        yield pa.record_batch({"a": nodes[keep], "b": first[keep]})


def _by_key(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition(shuffle_parts(df), "key").sortWithinPartitions("key", *order)


def _print_pairs(nodes: DataFrame) -> DataFrame:
    """``(a, b)``: nodes ``(node, n, print)`` whose SimHash fingerprints are equal or linked within 4 bits (``print_links``).

    Each node meets the first one of its fingerprint, and of linked fingerprints the first ones meet.
    """
    of_print = nodes.groupBy("print").agg(F.min("node").alias("first"))
    first = lambda x: of_print.select(F.col("print").alias(x), F.col("first").alias(f"first_{x}"))
    linked = print_links(of_print.select("print")).join(first("a"), "a").join(first("b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    return linked.unionByName(_by_key(nodes.select(F.col("print").alias("key"), "node", "n"), "node").mapInArrow(_hub_pairs, "a long, b long"))


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(a, b)`` of the rows ``(a, b, shingles of a, of b)`` that are near copies."""
    for batch in batches:
        sets = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False).view(np.uint64)) for c in map(batch.column, (2, 3))]
        part = lambda side, i: sets[side][1][sets[side][0][i] : sets[side][0][i + 1]]
        keep = np.array([similar(part(0, i), part(1, i)) for i in range(batch.num_rows)], bool)
        yield pa.record_batch({"a": batch.column(0).filter(pa.array(keep)), "b": batch.column(1).filter(pa.array(keep))})


def sketch(hashes: np.ndarray) -> bytes:
    """Of each of the sketch's places, whether an odd number of shingles falls on it: two sets differ in at least as many shingles as their sketches in bits."""
    odd = np.bincount((hashes >> np.uint64(7)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _sketches(column: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint64, (offsets[-1] - offsets[0]) // 8, offsets[0]).reshape(-1, SKETCH) if len(column) else np.empty((0, SKETCH), np.uint64)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with different roots that may be near copies by where a shingle stands in both, from rows ``(token, n, node, root, most, sketch)`` sorted by token and size.

    A pair may be one if the smaller's size is at most ``most`` of the larger and the larger's at most ``most`` of the smaller,
    and if their sketches do not show too many shingles of one alone.  Of a token, only rows of at least 4/5 of the present size are kept.
    """
    held = None
    for batch in larger(batches):
        new = [*(c.to_numpy(zero_copy_only=False) for c in batch.columns[:5]), _sketches(batch.column(5))]
        fresh_from = 0 if held is None else len(held[0])
        rows = new if held is None else [np.r_[h, c] for h, c in zip(held, new, strict=True)]
        token, n, node, root, most, bits = rows
        at = np.arange(fresh_from, len(token))
        # For each new row, the earlier rows of its token whose size is near enough: a run of the order.
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        begin = np.repeat(starts, np.diff(np.r_[starts, len(token)]))[at]
        least = -(-n[at] * LEAST[0] // LEAST[1])
        low = np.array([b + np.searchsorted(n[b:i], k) for b, i, k in zip(begin, at, least, strict=True)], np.int64)
        for some in np.array_split(np.arange(len(at)), int((at - low).sum()) // PAIRS + 1):
            count = (at - low)[some]
            big = np.repeat(at[some], count)
            small = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[some], count)
            keep = (root[big] != root[small]) & (n[small] <= most[big]) & (n[big] <= most[small])
            big, small = big[keep], small[keep]
            apart = np.bitwise_count(bits[big] ^ bits[small]).sum(axis=1, dtype=np.int64)
            near = apart * sum(LEAST) <= (n[big].astype(np.int64) + n[small]) * (LEAST[1] - LEAST[0])
            a, b = node[big[near]], node[small[near]]
            yield pa.record_batch({"a": np.maximum(a, b), "b": np.minimum(a, b)})
        same = (token == token[-1]) & (n * LEAST[1] >= n[-1] * LEAST[0]) if len(token) else np.empty(0, bool)
        held = [c[same] for c in rows]


def _prefix_pairs(far: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b)``: pairs of nodes ``(node, root)`` with different roots that may be near copies, by an exact prefix filter.

    Each set is read from its rarest shingle on (counted over ``far``).  If two sets of sizes n and m meet first in a shingle
    at place p of the one, they have at most n - p in common, and need 4/9 of n + m; so m is at most (5 n - 9 p) / 4.  Rows where
    no size fits drop out: the shingles of a passage that many otherwise different texts share stand behind their own
    ones, too far back to meet anybody.  Shingles within one root only are no meeting points.
    """
    low, high = LEAST
    tokens = far.join(sets, "node").select("node", "root", "n", F.explode("shingles").alias("token"))
    seen = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("many"), F.min("root").alias("r"), F.max("root").alias("s")).filter("many > 1")
    shared = tokens.join(seen.select("token", "many", (F.col("r") != F.col("s")).alias("meets")), "token")
    shared = shared.groupBy("node", "root", "n").agg(F.array_sort(F.collect_list(F.struct("many", "token", "meets"))).alias("t"))
    placed = shared.select("node", "root", "n", (F.col("n") - F.size("t")).alias("own"), F.posexplode("t").alias("i", "t")).filter("t.meets")
    most = F.floor((high * F.col("n") - (low + high) * (F.col("own") + F.col("i"))) / low).cast("long")
    rows = placed.select(F.col("t.token").alias("token"), "n", "node", "root", most.alias("most")).filter(F.col("most") * high >= F.col("n") * low)
    rows = rows.join(sets.select("node", "sketch"), "node").select("token", "n", "node", "root", "most", "sketch")
    rows = rows.repartition(shuffle_parts(far), "token").sortWithinPartitions("token", "n", "node")
    return rows.mapInArrow(_meetings, "a long, b long")


@F.arrow_udf(StructType([StructField("shingles", ArrayType(LongType())), StructField("sketch", BinaryType())]))
def _sets(texts: pa.Array) -> pa.Array:
    sets = [shingles(t.as_py()) for t in texts]
    return pa.StructArray.from_arrays([pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64())), pa.array(map(sketch, sets), pa.binary())], ["shingles", "sketch"])


def similar_copies(documents: DataFrame) -> DataFrame:
    """``(doc_id, text_key, component)``, one row for each row of documents ``(doc_id, text)``.

    Two texts are near copies if at least 4 of 5 of their different five-word shingles (A-Z
    lower-cased) are common to both; texts with the same words are, and so are all texts without words.
    Texts under five words are near copies of the same words only.  ``component`` is equal for
    rows that are linked over near copies.  ``text_key`` tells apart rows that repeat a doc_id.  Null texts are
    empty; a null doc_id is a row like others.  Other columns are ignored; an empty table gives an empty one.

    Texts of the same words are one node.  Nodes meet where their SimHash fingerprints lie within 4 bits, found by
    Golay codewords (``_print_pairs``), and, as near copies may lie further apart, where a band of their MinHash
    signatures is equal; every link is decided by the shingles themselves.  First each
    member of a bucket is held against one other, so that a large group becomes one
    component by as many pairs as it has members.  Nodes that still share a bucket with
    another component meet by a prefix filter over their shingles (``_prefix_pairs``), which finds every near copy
    among them and lets texts around one common passage alone.
    """
    small_batches(documents)
    made = _signature("text").alias("s")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), _node(F.col("text")).alias("node"), made)
    rows = saved(rows.select("doc_id", "text_key", "node", "s.n", "s.keys", "s.print"))
    # A text without shingles is a near copy of the same words only.
    printed = saved(_print_pairs(saved(rows.filter("n > 0").select("node", "n", "print").dropDuplicates(["node"]))).distinct())
    keyed = rows.select("node", "n", "keys").dropDuplicates(["node"]).select(F.explode("keys").alias("key"), "node", "n")
    met = saved(_by_key(keyed, "node").mapInArrow(_met, "key long, node long, n int"))
    meeting = met.select("node").unionByName(printed.select(F.explode(F.array("a", "b")).alias("node")))
    texts = documents.select(_node(F.col("text")).alias("node"), "text").join(meeting.distinct(), "node", "left_semi")
    sets = saved(texts.groupBy("node").agg(F.min("text").alias("text")).select("node", _sets("text").alias("s")).select("node", "s.*", F.size("s.shingles").alias("n")))

    def decided(pairs: DataFrame) -> DataFrame:
        side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}"))
        both = pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "of_a", "of_b")
        return saved(both.mapInArrow(_decided, "a long, b long"))

    links = decided(printed.unionByName(_by_key(met, "node").mapInArrow(_hub_pairs, "a long, b long")))
    rooted = saved(met.join(components(links), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s").select("key")
    far = saved(rooted.join(mixed, "key", "left_semi").select("node", "root").distinct())
    links = links.unionByName(decided(_prefix_pairs(far, sets)))
    return rows.join(components(links), "node", "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("component"))


def drop_similar(documents: DataFrame) -> DataFrame:
    """The documents ``(doc_id, text, ...)`` without near copies: exactly one row of each group of ``similar_copies`` stays, all columns as they are.

    That is the row with the smallest doc_id, null after all others, and of its rows the one with the smallest ``text_key``.
    Rows are judged one by one, so an unrelated text under a repeated doc_id stays; of rows that
    repeat doc_id and text any one does.  An empty table gives an empty one.
    """
    doc, key = fresh(documents, "_doc", "_text_key")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    copies = similar_copies(documents).groupBy("component", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    judged = copies.join(copies.groupBy("component").agg(F.min(order).alias("first")), "component")
    judged = judged.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key + "_"), "n", (order == F.col("first")).alias("keep"))
    rows = documents.withColumn(key, text_key(F.col("text")))
    mine = lambda these: (rows["doc_id"].cast("long").eqNullSafe(these[doc])) & (rows[key] == these[key + "_"])
    # A doc_id with its text lies in one component, so every row is judged once.
    touched = saved(judged.filter("NOT keep OR n > 1"))
    once = rows.join(touched, mine(touched), "left_anti")
    again = touched.filter("keep")
    repeated = rows.join(again, mine(again), "left_semi").dropDuplicates(["doc_id", key])
    return once.unionByName(repeated).select(*documents.columns)
