"""Near copies among rendered documents: SimHash fingerprints met by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from inkshard.llm.common import ASCII_LOWER, larger, saved, shuffle_parts, small_batches

SHINGLE, DISTANCE, SEED = 4, 4, 42
# Fixed value: generator polynomial of the binary Golay code of length 23, dimension 12, distance 7.
GENERATOR = 0b110001110101
LENGTH, CHECKS = 23, 11
#: The 64 bits in three segments, none longer than the code.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: A bucket with more fingerprints than a ball of radius 2 has points goes by ball points.
HOT_BUCKET = 1 + 64 + 64 * 63 // 2


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of 4-word shingles, as a signed integer; 0 without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    shingles = zip(*(words[i:] for i in range(SHINGLE)), strict=False) if len(words) >= SHINGLE else [words]
    h = np.array([digest(join(s), SEED) for s in shingles], dtype="<u8")
    ones = sum(np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for part in np.array_split(h, len(h) // 65536 + 1))
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def _remainder(word: int) -> int:
    for shift in range(LENGTH - 1 - CHECKS, -1, -1):
        if word >> (shift + CHECKS) & 1:
            word ^= GENERATOR << shift
    return word


@cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and high 11 bits, and for each remainder the errors that lead to codewords.

    The code is perfect: one codeword lies within 3 bits of a word.  A word at exactly 3 has five
    more at 4.  Two words that differ in at most 2 bits have a codeword within 4 of both:
    the one nearest to a word midway.
    """
    of_bit = [_remainder(1 << i) for i in range(LENGTH)]
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for i in range(12):
        low[1 << i : 2 << i] = low[: 1 << i] ^ of_bit[i]
    for i in range(11):
        high[1 << i : 2 << i] = high[: 1 << i] ^ of_bit[12 + i]
    errors: list[list[int]] = [[] for _ in range(1 << CHECKS)]
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            r = 0
            for b in bits:
                r ^= of_bit[b]
            if weight < 4 or (errors[r] and errors[r][0].bit_count() == 3):
                errors[r].append(sum(1 << b for b in bits))
    table = np.full((1 << CHECKS, 6), -1, np.int64)
    for r, es in enumerate(errors):
        table[r, : len(es)] = es
    return low, high, table


def codewords(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word the indices of the codewords within 4 bits: nearest first, -1 where there are fewer than six."""
    low, high, table = _golay()
    errors = table[low[words & 0xFFF] ^ high[words >> 12]]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> CHECKS)


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(keys, rows)``: bucket keys of fingerprints such that any two within 4 bits share one.

    Of three segments the two with fewest errors have at most two between them: 0 and at most 2, or 1
    and 1.  So the keys are (one segment exactly, codewords near another) and, for 1 and 1,
    (nearest codeword of one, codewords near the other) both ways round: if u and v differ
    in one bit there, v is within 4 of u's nearest codeword.
    """
    bits = prints.view(np.uint64)
    parts = [(bits >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [codewords(p) for p in parts]
    keys = []
    for tag, (i, j) in enumerate(permutations(range(3), 2)):
        keys.append(np.where(near[j] < 0, -1, tag << 40 | parts[i][:, None] << 12 | near[j]))
    for tag, (i, j) in enumerate(combinations(range(3), 2), start=6):
        keys.append(np.where(near[j] < 0, -1, tag << 40 | near[i][:, :1] << 12 | near[j]))
        keys.append(np.where(near[i] < 0, -1, tag << 40 | near[i] << 12 | near[j][:, :1])[:, 1:])
    table = np.concatenate(keys, axis=1)
    rows, columns = np.nonzero(table >= 0)
    return table[rows, columns], rows


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        for part in np.array_split(prints, len(prints) // 2000 + 1):
            keys, rows = fuzzy_keys(part)
            yield pa.record_batch({"key": keys, "print": part[rows]})


def _ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every point within 2 bits of a fingerprint; two fingerprints within 4 share one, and no others do."""
    masks = np.array([sum(1 << b for b in bits) for n in range(3) for bits in combinations(range(64), n)], dtype=np.uint64).view(np.int64)
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        for part in np.array_split(prints, len(prints) // 50 + 1):
            yield pa.record_batch({"key": (part[:, None] ^ masks).ravel(), "print": np.repeat(part, len(masks))})


def _bucket_links(limit: int):
    """Links inside buckets, from rows sorted by key; the members of a bucket above ``limit`` come out without a partner."""

    def links(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each member tied to the first one its verified links lead to; all pairs would say no more."""
        first, step = np.arange(len(keys)), 1
        at = first
        while len(at := at[at + step < len(keys)]) and len(at := at[keys[at + step] == keys[at]]):
            a = at[np.bitwise_count((prints[at] ^ prints[at + step]).view(np.uint64)) <= DISTANCE]
            while len(a := a[first[a] != first[a + step]]):
                low, high = np.minimum(first[a], first[a + step]), np.maximum(first[a], first[a + step])
                np.minimum.at(first, high, low)
                while (first != first[first]).any():
                    first = first[first]
            step += 1
        tied = np.flatnonzero(first != np.arange(len(keys)))
        return prints[tied], prints[first[tied]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints, hot = np.empty(0, np.int64), np.empty(0, np.int64), None

        def emit(keys, prints):
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
            sizes = np.diff(np.r_[starts, len(keys)])
            large = np.repeat((sizes > limit) | (keys[starts] == hot if hot is not None else False), sizes)
            a, b = links(keys[~large], prints[~large])
            alone = np.unique(prints[large])
            none = pa.nulls(len(alone), pa.int64())
            return pa.record_batch({"a": pa.concat_arrays([pa.array(a), pa.array(alone)]), "b": pa.concat_arrays([pa.array(b), none])})

        for batch in larger(batches):
            keys = np.r_[keys, batch.column(0).to_numpy(zero_copy_only=False)]
            prints = np.r_[prints, batch.column(1).to_numpy(zero_copy_only=False)]
            if not len(keys):
                continue
            end = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
            if len(keys) - end > limit or keys[-1] == hot:
                yield emit(keys, prints)
                hot, keys, prints = keys[-1], keys[:0], prints[:0]
            elif end:
                yield emit(keys[:end], prints[:end])
                keys, prints = keys[end:], prints[end:]
        if len(keys):
            yield emit(keys, prints)

    return run


def _star_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row linked to the first of its key, from rows sorted by key."""
    key = first = None
    for batch in larger(batches):
        keys, prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(keys):
            continue
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        heads = prints[starts].copy()
        if keys[0] == key:
            heads[0] = first
        to = np.repeat(heads, np.diff(np.r_[starts, len(keys)]))
        key, first = keys[-1], heads[-1]
        yield pa.record_batch({"a": prints[prints != to], "b": to[prints != to]})


def print_links(prints: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """``(a, b)``: links that join up all distinct fingerprints (column ``print``) within 4 bits, none twice.

    A bucket is read as a run of sorted rows and its pairs are verified in place.  A bucket
    with more than ``hot_bucket`` members would cost more pairs than its members have points
    within 2 bits; its members are listed under those points instead, where sharing a
    point proves a link and a star over each point says all of them.
    """
    parts = shuffle_parts(prints)
    by_key = lambda df: df.repartition(parts, "key").sortWithinPartitions("key", "print")
    found = saved(by_key(prints.mapInArrow(_keyed, "key long, print long")).mapInArrow(_bucket_links(hot_bucket), "a long, b long").distinct())
    hot = found.filter("b IS NULL").select(F.col("a").alias("print")).distinct()
    stars = by_key(hot.mapInArrow(_ball, "key long, print long")).mapInArrow(_star_links, "a long, b long")
    return found.filter("b IS NOT NULL").unionByName(stars).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)`` but the roots: the smallest node reachable.

    Alternates two steps until nothing moves: every larger neighbour of a node is tied to the node's
    smallest neighbour, then every smaller one is.  Edges live in saved tables; the driver
    sees a count and a checksum for each round.
    """
    edges = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        larger = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        met = larger.join(least, "u")
        edges = saved(met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v"))).distinct())
        if (after := state(edges)) == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


@F.arrow_udf(LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())


def near_copies(documents: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each row of documents ``(doc_id, text)``.

    The fingerprint (16 hexadecimal digits) is the SimHash of the text's 4-word shingles, A-Z
    lower-cased, hashed by XXH64; texts under 4 words are one shingle, texts without words
    and null texts have fingerprint zero and are linked like any other.  Fingerprints that
    differ in at most 4 bits are linked; ``component_id`` is the smallest doc_id reachable.
    Repeated rows link to each other; a null doc_id is never the smallest unless the
    component has no other.  Other columns are ignored.

    Equal fingerprints are merged first, so a text that a third of all rows share is one
    node.  Links and components stay tables.
    """
    prints = saved(small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), _fingerprints("text").alias("print")))
    nodes = prints.groupBy("print").agg(F.min("doc_id").alias("first_id"))
    roots = components(print_links(nodes.select("print"), hot_bucket)).withColumnRenamed("node", "print")
    rooted = nodes.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    first = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = rooted.join(first, "root").select("print", "component_id")
    return prints.join(labels, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
