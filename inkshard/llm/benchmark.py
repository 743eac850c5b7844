"""Passages of test items inside rendered documents, found by a suffix automaton of the items."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from inkshard.llm.common import ASCII_LOWER, fresh, saved, small_batches

WINDOW = 10
#: Item words in one automaton (about 100 MB); more items are dealt to several automata, one pass each.
BLOCK_WORDS = 100_000

#: Bytes: A-Z lower-cased, whatever is not a letter, digit or part of a longer character a space.
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256)).translate(ASCII_LOWER)
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")

_SPAN = StructType([StructField("start", IntegerType()), StructField("length", IntegerType())])
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
_HITS = StructType([StructField("n_words", LongType()), StructField("spans", ArrayType(_SPAN)), StructField("items", ArrayType(LongType()))])


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton of items, as words; knows which items hold a window."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.length, self.link, self.next = [0], [-1], [{}]
        ends: dict[int, set[int]] = {}
        short: dict[int, list[tuple[int, int]]] = {}
        for item, words in items:
            at = 0
            for w in words:
                at = self._extend(at, self.vocabulary.setdefault(w, len(self.vocabulary) + 1))
                ends.setdefault(at, set()).add(item)
            if 0 < len(words) < window:
                short.setdefault(at, []).append((len(words), item))
        self.shortest = min([window, *(n for own in short.values() for n, _ in own)])
        self._label(ends, short)

    def _extend(self, last: int, word: int) -> int:
        length, link, nexts = self.length, self.link, self.next
        if word in nexts[last]:
            target = nexts[last][word]
            return target if length[target] == length[last] + 1 else self._split(last, word, target)
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        nexts.append({})
        p = last
        while p >= 0 and word not in nexts[p]:
            nexts[p][word] = new
            p = link[p]
        if p >= 0:
            target = nexts[p][word]
            link[new] = target if length[target] == length[p] + 1 else self._split(p, word, target)
        return new

    def _split(self, p: int, word: int, target: int) -> int:
        clone = len(self.length)
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[target])
        self.next.append(dict(self.next[target]))
        self.link[target] = clone
        while p >= 0 and self.next[p].get(word) == target:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _label(self, ends: dict[int, set[int]], short: dict[int, list[tuple[int, int]]]) -> None:
        """``held[v]``: items that hold the window which is the last words of a match at v; ``short[v]``: whole short items that end there."""
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        self.held: dict[int, tuple[int, ...]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for v in reversed(order):
            if self.length[self.link[v]] >= self.window:
                ends.setdefault(self.link[v], set()).update(ends.get(v, ()))
        for v in order:
            up = self.link[v]
            if self.length[v] >= self.window:
                self.held[v] = self.held[up] if self.length[up] >= self.window else tuple(sorted(ends.get(v, ())))
            if own := short.get(v, []) + self.short.get(up, []):
                self.short[v] = own

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """``(end, length, items)`` of every window occurrence, streaming the longest match at each word."""
        known = np.fromiter(map(self.vocabulary.get, words, [0] * len(words)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.r_[0, known > 0, 0]))
        link, length, nexts, window, held, short = self.link, self.length, self.next, self.window, self.held, self.short
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - start < self.shortest:
                continue
            state = longest = 0
            for i, w in enumerate(known[start:end].tolist(), start + 1):
                while state and w not in nexts[state]:
                    state = link[state]
                    longest = length[state]
                if w in nexts[state]:
                    state = nexts[state][w]
                    longest += 1
                if longest >= window:
                    yield i, window, held[state]
                if state in short:
                    for n, item in short[state]:
                        if n <= longest:
                            yield i, n, (item,)

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[int]]:
        """Number of words, spans ``(start, length)`` of hit words, item ids."""
        words = item_words(text)
        spans: list[list[int]] = []
        items: set[int] = set()
        for end, n, found in self.matches(words):
            items.update(found)
            start = end - n
            while spans and spans[-1][0] >= start:
                start = min(start, spans.pop()[0])
            if spans and spans[-1][1] >= start:
                spans[-1][1] = max(end, spans[-1][1])
            else:
                spans.append([start, end])
        return len(words), [(a, b - a) for a, b in spans], sorted(items)


def _hit_column(automaton) -> Callable[[Column], Column]:
    @F.arrow_udf(_HITS)
    def hits(texts: pa.Array) -> pa.Array:
        n_words, spans, items = [], [], []
        for text in texts:
            n, own, found = automaton.value.hits(text.as_py())
            n_words.append(n)
            spans.append([{"start": s, "length": k} for s, k in own])
            items.append(found)
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(spans, _ARROW_SPANS), pa.array(items, pa.list_(pa.int64()))], ["n_words", "spans", "items"])

    # Not to be evaluated once more for a filter.
    return hits.asNondeterministic()


def _automata(items: DataFrame, window: int, block_words: int) -> list:
    """Broadcast automata of the items, each of a bounded number of words (a longer item stands alone)."""
    spark = items.sparkSession
    rows = items.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    # Two bytes at least for a word and its end, so this is no less than the number of words.
    bound = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 2 + 1
    blocks = -(-bound * 2 // block_words) if bound > block_words else 1
    out = []
    for b in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        automaton = Automaton([(r["item_id"], item_words(r["text"])) for r in sorted(part, key=lambda r: (r["item_id"], r["text"]))], window)
        if automaton.vocabulary or b == 0:
            out.append(spark.sparkContext.broadcast(automaton))
    return out


def merge_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans ``(start, length)`` without overlap or touch."""
    out: list[list[int]] = []
    for start, length in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + length)
        else:
            out.append([start, start + length])
    return [(a, b - a) for a, b in out]


@F.arrow_udf(ArrayType(_SPAN))
def _merged(spans: pa.Array) -> pa.Array:
    return pa.array([[{"start": s, "length": k} for s, k in merge_spans((x["start"], x["length"]) for x in own.as_py())] for own in spans], _ARROW_SPANS)


def benchmark_hits(documents: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``documents`` with ``n_words, n_hit, hit_spans, hit_items``.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text, A-Z lower-cased.  A window is
    ``window`` consecutive words of an item ``(item_id, text)``; an item of fewer words, but not none, is
    one window.  A document word inside any occurrence of a window is hit.  ``hit_spans``
    are runs ``(start, length)`` of hit words, ``hit_items`` the sorted ids of items with a window
    in the document.

    A null text has no words; items with a null id or text are ignored, items that repeat an id
    are one item with several texts; no items, no hits.  Columns that bear the names of new
    ones are replaced, all others kept.

    The items are broadcast as an automaton of at most about ``block_words`` words; each document passes it
    in its row, so nothing is shuffled.  More items take several passes, each saved before the
    next, so that a task holds one automaton at a time.
    """
    automata = _automata(items, window, block_words)
    small_batches(documents)
    names = fresh(documents, *[f"_hits_{i}" for i in range(len(automata))])
    rows = documents
    for i, (name, automaton) in enumerate(zip(names, automata, strict=True)):
        rows = rows.withColumn(name, _hit_column(automaton)(F.col("text")))
        if i < len(names) - 1:
            rows = saved(rows)
    spans, found = F.col(f"{names[0]}.spans"), F.col(f"{names[0]}.items")
    if len(names) > 1:
        spans = _merged(F.concat(*[F.col(f"{n}.spans") for n in names]))
        found = F.array_sort(F.array_distinct(F.concat(*[F.col(f"{n}.items") for n in names])))
    rows = rows.withColumns({"n_words": F.col(f"{names[0]}.n_words"), "hit_spans": spans, "hit_items": found}).drop(*names)
    return rows.withColumn("n_hit", F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["length"]))


def cut_words(text: str, spans: Iterable[tuple[int, int]]) -> str:
    """The text without the spans of words, each cut from its first character to its last."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for start, length in spans:
        out.append(text[at : places[start][0]])
        at = places[start + length - 1][1]
    return "".join([*out, text[at:]])


_CLEAN = StructType([StructField("spans", ArrayType(_SPAN)), StructField("n_words", LongType()), StructField("text", StringType())])


def _cleaner(automaton) -> Callable[[Column, Column], Column]:
    """Spans of hits joined to those known so far, and the text without them: null unless there are any."""

    @F.arrow_udf(_CLEAN)
    def clean(texts: pa.Array, known: pa.Array) -> pa.Array:
        spans, n_words, out = [], [], []
        for text, before in zip(texts, known, strict=True):
            text = text.as_py()
            n, own, _ = automaton.value.hits(text)
            own = merge_spans([*own, *((x["start"], x["length"]) for x in before.as_py() or ())])
            spans.append([{"start": s, "length": k} for s, k in own])
            n_words.append(n)
            out.append(cut_words(text, own) if own else None)
        return pa.StructArray.from_arrays([pa.array(spans, _ARROW_SPANS), pa.array(n_words, pa.int64()), pa.array(out, pa.string())], ["spans", "n_words", "text"])

    return clean.asNondeterministic()


def decontaminate(documents: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``documents`` without passages of the items: hit spans are cut from the text.

    A document with more than ``max_coverage`` of its words hit is little else than test items and
    goes as a whole.  Documents without a hit, null texts among them, stay as they are.
    All columns are kept, no column is added.  For words, windows and bounds see ``benchmark_hits``.
    """
    automata = _automata(items, window, block_words)
    small_batches(documents)
    (clean,) = fresh(documents, "_clean")
    rows = documents
    for i, automaton in enumerate(automata):
        known = F.col(f"{clean}.spans") if i else F.lit(None).cast(ArrayType(_SPAN))
        rows = rows.withColumn(clean, _cleaner(automaton)(F.col("text"), known))
        if i < len(automata) - 1:
            rows = saved(rows)
    n_hit = F.aggregate(F.col(f"{clean}.spans"), F.lit(0).cast("long"), lambda n, s: n + s["length"])
    rows = rows.filter(n_hit <= F.lit(max_coverage) * F.col(f"{clean}.n_words"))
    return rows.withColumn("text", F.coalesce(F.col(f"{clean}.text"), F.col("text"))).drop(clean)
