"""Rendered documents packed into token sequences of one length, best fit first."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkshard.llm.common import give_back, numbered, saved, small_batches

SEQUENCE = 2048
END_ID = 0
#: Words whose ids a worker remembers, and the bytes of text it works on at a time (a single text may be longer).
REMEMBERED, BLOCK = 700_000, 4 << 20
#: Words given to the tokenizer at a time: its own table of their tokens is many times their size.
AT_ONCE = 20_000
#: ASCII signs but the apostrophe, which may begin a token of letters.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordTokenizer:
    """Ids of texts by a tokenizer that drops white space, as ``encode(text, add_special_tokens=False)`` gives them.

    Such a tokenizer takes each word for itself, so words that were met before cost a lookup.
    Lower-casing A-Z first changes nothing, as the tokenizer lower-cases.  Texts that hold the
    beginning of a special token's name go to the tokenizer whole.  New words of letters that
    need no normalising are encoded many at a time and told apart by the suffix that ends a word.
    """

    def __init__(self, path: str, remember: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix, vocabulary = self.plain.model.end_of_word_suffix, self.plain.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.suffixed = bool(suffix)
        self.known: dict[str, bytes] = {}
        self.remember = remember

    def _simple(self, word: str) -> bool:
        """A word of letters in normal form: one token run, which normalising leaves alone."""
        if not self.suffixed or not word.isalpha():
            return False
        return word.isascii() or (word.islower() and is_normalized("NFC", word))

    def _encode(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of words that are not known.

        Signs at the end of a word are encoded for themselves: tokens never reach from a letter or
        digit to a sign.
        """
        new: dict[str, bytes] = {}
        plain, rest, split = [], [], []
        for w in words:
            if self._simple(w):
                plain.append(w)
                continue
            core = w.rstrip(_SIGNS)
            if len(core) < len(w) and core and core[-1].isalnum():
                split.append((w, core, w[len(core) :]))
            else:
                rest.append(w)
        parts = {part for _, *parts in split for part in parts}
        for w in parts.difference(plain, rest):
            if w in self.known:
                new[w] = self.known[w]
            else:
                (plain if self._simple(w) else rest).append(w)
        for some in (plain[i : i + AT_ONCE] for i in range(0, len(plain), AT_ONCE)):
            ids = np.array(self.plain.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            raw, cuts = ids.tobytes(), [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
            new.update((w, raw[a:b]) for w, a, b in zip(some, cuts[:-1], cuts[1:], strict=True))
        for some in (rest[i : i + AT_ONCE] for i in range(0, len(rest), AT_ONCE)):
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                new[w] = np.array(e.ids, dtype="<u4").tobytes()
        new.update((w, new[core] + new[signs]) for w, core, signs in split)
        return new

    def ids(self, texts: pa.Array) -> Iterator[bytes]:
        """All ids of each text, unsigned 32-bit little-endian."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK, side="right")))
            yield from self._block(texts.slice(at, end - at))
            at = end

    def _block(self, texts: pa.Array) -> Iterator[bytes]:
        special = pc.fill_null(pc.match_substring(texts, "<|"), False)
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(special, "", pc.fill_null(texts, ""))))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        found = list(map(self.known.get, words))
        if None in found:
            new = self._encode(w for w, f in zip(words, found, strict=True) if f is None)
            found = [new[w] if f is None else f for w, f in zip(words, found, strict=True)]
            if len(self.known) + len(new) <= self.remember:
                self.known.update(new)
        # The ids of all words side by side; the offsets say where a text's begin.
        joined = pa.array(found, pa.large_binary()).take(coded.indices)
        starts = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1, joined.offset * 8)
        edges = starts[split.offsets.to_numpy()].tolist() if len(joined) else [0] * (len(split) + 1)
        data = joined.buffers()[2]
        for text, odd, begin, end in zip(texts, special.to_pylist(), edges[:-1], edges[1:], strict=True):
            if odd:
                yield np.array(self.tokenizer.encode(text.as_py(), add_special_tokens=False).ids, dtype="<u4").tobytes()
            else:
                yield data[begin:end].to_pybytes() if end > begin else b""


_tokenizers: dict[tuple[str, int], WordTokenizer] = {}


def _pieces_of(path: str, limit: int, keep_ids: bool, remember: int = REMEMBERED):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, remember) not in _tokenizers:
            _tokenizers[path, remember] = WordTokenizer(path, remember)
        tokenizer = _tokenizers[path, remember]
        for batch in batches:
            columns: dict[str, list] = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids)}
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokenizer.ids(batch.column(1)), strict=True):
                ids += END_ID.to_bytes(4, "little")
                for i, at in enumerate(range(0, len(ids), 4 * limit)):
                    piece = ids[at : at + 4 * limit]
                    columns["doc_id"].append(doc_id)
                    columns["piece"].append(i)
                    columns["start"].append(at // 4)
                    columns["length"].append(len(piece) // 4)
                    columns["ids_crc32"].append(zlib.crc32(piece))
                    if keep_ids:
                        columns["ids"].append(piece)
            types = {"piece": pa.int32(), "ids": pa.binary()}
            yield pa.record_batch({n: pa.array(v, types.get(n, pa.int64())) for n, v in columns.items()})
        give_back()

    return run


def best_fit(counts: dict[int, int], limit: int = SEQUENCE) -> np.ndarray:
    """Where the pieces of each length go: rows ``(length, first rank, sequence of that rank, offset)``.

    Pieces of one length are alike, and so are sequences with one gap, so both sides are runs: a
    length with its count, a gap with a run of sequence numbers.  In descending order a length
    takes the smallest gaps that hold it, as many as it has pieces; ranks say which piece
    takes which.  Gaps shrink, and the rest of the length sweeps on to the next larger gap;
    what finds none opens sequences.  Every later rank of a run has the next sequence.  Work and
    result depend on ``limit``, not on the number of pieces.
    """
    out: list[tuple[int, int, int, int]] = []
    sizes: list[int] = []  # gaps there are, sorted
    runs: dict[int, list[tuple[int, int]]] = {}  # of each gap: (first sequence, how many)
    opened = 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                insort(sizes, gap)
            runs.setdefault(gap, []).append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left and (i := bisect_left(sizes, length)) < len(sizes):
            gap = sizes[i]
            first, n = runs[gap].pop()
            if not runs[gap]:
                del runs[gap], sizes[i]
            taken = min(n, left)
            out.append((length, rank, first, limit - gap))
            leave(gap - length, first, taken)
            leave(gap, first + taken, n - taken)
            rank, left = rank + taken, left - taken
        if left:
            room = limit // length
            new = -(-left // room)
            filled = [min(new, left - slot * new) for slot in range(room) if left > slot * new]
            for slot, n in enumerate(filled):
                out.append((length, rank, opened, slot * length))
                rank += n
            for slot, n in enumerate(filled):
                more = filled[slot + 1] if slot + 1 < len(filled) else 0
                leave(limit - (slot + 1) * length, opened + more, n - more)
            opened += new
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 4)


def _place(plan: np.ndarray):
    key = plan[:, 0] << 44 | plan[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            run_of = np.searchsorted(key, length << 44 | rank, side="right") - 1
            rest = batch.drop_columns(["rank"])
            rest = rest.append_column("sequence_id", pa.array(plan[run_of, 2] + rank - plan[run_of, 1]))
            yield rest.append_column("offset", pa.array(plan[run_of, 3]))

    return run


def pack_documents(documents: DataFrame, tokenizer_path: str, limit: int = SEQUENCE, keep_ids: bool = False, remember: int = REMEMBERED) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` of rendered documents ``(doc_id, text)``.

    A document is its text's ids by the tokenizer in ``tokenizer_path`` (one that drops white space, see
    ``WordTokenizer``; the file must be where the executors can read it), then id 0.  Documents of
    more than ``limit`` ids are cut into pieces of that length, the last one shorter.  Pieces are
    packed into sequences of at most ``limit`` ids.  ``start`` counts the document's ids before the
    piece, ``offset`` the sequence's.  With ``keep_ids`` the ids (unsigned 32-bit, little-endian) come along as
    ``ids``, see ``sequences``.  ``remember`` is how many words' ids a worker keeps: fewer take less memory
    (some 140 bytes each) and more time, with the same result.

    Null and empty texts are the single id 0.  Repeated rows and null doc_ids are packed like any
    other.  Other columns are ignored.

    Best fit, bulk-synchronous: lengths are counted in one aggregate of at most ``limit`` rows; rounds run
    over lengths and gaps in sorted order (``best_fit``); each piece then finds its place by its rank
    among the pieces of its length, which a distributed range sort gives.  A length that most
    pieces share spreads over many tasks.
    """
    ids = ", ids binary" if keep_ids else ""
    text = small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = saved(text.mapInArrow(_pieces_of(tokenizer_path, limit, keep_ids, remember), f"doc_id long, piece int, start long, length long, ids_crc32 long{ids}"))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    ranked = numbered(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "rank")
    schema = f"length long, doc_id long, piece int, start long, ids_crc32 long{ids}, sequence_id long, offset long"
    ranked = ranked.select("length", "doc_id", "piece", "start", "ids_crc32", *["ids"] * keep_ids, "rank")
    placed = ranked.mapInArrow(_place(best_fit(counts, limit)), schema)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids)


def sequences(placed: DataFrame) -> DataFrame:
    """``(sequence_id, n_ids, ids)`` from pieces packed with ``keep_ids``; a sequence is a bounded number of ids.

    Other columns are ignored; no pieces give no sequences.  Every piece has its own place, so there are no ties.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), joined.alias("ids"))
