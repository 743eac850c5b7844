"""Rendered documents as fill-in-middle samples: every byte gets its displacement."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inkshard.llm.common import SPACE, small_batches

MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
PLAIN, SPM, PSM = FORMS = ("plain", "spm", "psm")
#: Parts of a sample in the order of its output.
LAYOUT = {SPM: ("suffix", "prefix", "middle"), PSM: ("prefix", "suffix", "middle")}
#: Bytes worked on at a time, unless one text is longer.
BLOCK = 1 << 22
_MARK = 3
_IS_SPACE = np.isin(np.arange(256), list(SPACE.encode()))
_SAMPLE = "n long, form string, prefix_chars long, middle_chars long, output string"


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an array of strings without nulls."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, "<i4")[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)


def _strings(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype("<i4").tobytes()), pa.py_buffer(data.tobytes()))


def _blocks(offsets: np.ndarray) -> Iterator[slice]:
    """Runs of rows of about ``BLOCK`` bytes; a longer text is a run of its own."""
    at = 0
    while at < len(offsets) - 1:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1)
        yield slice(at, stop)
        at = stop


def _marks_in(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, place)`` of every mark that lies inside a row, in order."""
    letters = [m[1] for m in MARKS.values()]
    at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")) & np.isin(data[1:-1], letters)) if len(data) > 2 else np.empty(0, np.int64)
    row = np.searchsorted(offsets, at, side="right") - 1
    inside = at + _MARK <= offsets[row + 1]
    return row[inside], at[inside]


def _token_cuts(offsets: np.ndarray, data: np.ndarray, draws: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each row, and for each draw the byte after so many of them as it says, modulo their number and one."""
    space = _IS_SPACE[data]
    ends = np.zeros(len(data), bool)
    ends[:-1] = ~space[:-1] & space[1:]
    ends[offsets[1:][np.diff(offsets) > 0] - 1] = True  # a row's last byte ends a word or the white space behind it
    at = np.flatnonzero(ends) + 1
    first = np.searchsorted(at, offsets, side="right")
    n = np.diff(first)
    after = np.r_[0, at]
    cuts = [np.where((k := d % (n + 1)) > 0, after[first[:-1] + k], offsets[:-1]) for d in draws]
    return n, np.stack(cuts)


def _part_starts(lengths: dict[str, np.ndarray], forms: np.ndarray, begin: np.ndarray) -> dict[str, np.ndarray]:
    """Where each part of a row stands in the output that begins at ``begin``; a plain row's parts follow each other."""
    starts = {"prefix": begin, "middle": begin + lengths["prefix"], "suffix": begin + lengths["prefix"] + lengths["middle"]}
    for code, form in enumerate(FORMS[1:], start=1):
        at = begin
        for part in LAYOUT[form]:
            starts[part] = np.where(forms == code, at + _MARK, starts[part])
            at = at + _MARK + lengths[part]
    return starts


def _shifts(size: int, places: list[np.ndarray], starts: list[np.ndarray]) -> np.ndarray:
    """Output place of every input byte.

    ``places`` are the parts' beginnings in the input, ``starts`` those in the output, row by
    row.  The change of the shift stands at each part's beginning (empty parts add up there); its running sum is the shift.
    """
    begin = np.stack(places, axis=1).ravel()
    change = np.diff((np.stack(starts, axis=1) - np.stack(places, axis=1)).ravel(), prepend=0)
    out = np.zeros(size + 1, np.int64)
    np.add.at(out, begin, change)
    return np.cumsum(out[:-1]) + np.arange(size)


def scatter(offsets: np.ndarray, data: np.ndarray, cuts: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of the samples: rows cut at the two bytes ``cuts``, laid out as ``forms`` (places in ``FORMS``) say."""
    low, high = cuts.min(axis=0), cuts.max(axis=0)
    lengths = {"prefix": low - offsets[:-1], "middle": high - low, "suffix": offsets[1:] - high}
    moved = forms > 0
    out_offsets = np.r_[0, np.cumsum(np.diff(offsets) + np.where(moved, _MARK * len(MARKS), 0))]
    starts = _part_starts(lengths, forms, out_offsets[:-1])
    out = np.empty(out_offsets[-1], np.uint8)
    out[_shifts(len(data), [offsets[:-1], low, high], [starts["prefix"], starts["middle"], starts["suffix"]])] = data
    for part, mark in MARKS.items():
        out[(starts[part][moved, None] + np.arange(-_MARK, 0)).ravel()] = np.tile(np.frombuffer(mark, np.uint8), int(moved.sum()))
    return out_offsets, out


def gather(offsets: np.ndarray, data: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of the texts behind samples, from outputs and forms alone."""
    row, at = _marks_in(offsets, data)
    at = at[forms[row] > 0]
    moved = np.flatnonzero(forms > 0)
    if len(at) != _MARK * len(moved):
        raise ValueError("a sample without its three marks")
    marks = at.reshape(-1, _MARK)
    stops = np.c_[marks[:, 1:], offsets[moved + 1]]
    size = np.diff(offsets) - np.where(forms > 0, _MARK * len(MARKS), 0)
    lengths = {"prefix": size.copy(), "middle": np.zeros_like(size), "suffix": np.zeros_like(size)}
    for code, form in enumerate(FORMS[1:], start=1):
        mine = forms[moved] == code
        for i, part in enumerate(LAYOUT[form]):
            if (data[marks[mine, i] + 1] != MARKS[part][1]).any():
                raise ValueError("marks in another order than the form's")
            lengths[part][moved[mine]] = (stops - marks)[mine, i] - _MARK
    text_offsets = np.r_[0, np.cumsum(size)]
    places = [text_offsets[:-1], text_offsets[:-1] + lengths["prefix"], text_offsets[1:] - lengths["suffix"]]
    starts = _part_starts(lengths, forms, offsets[:-1])
    return text_offsets, data[_shifts(int(text_offsets[-1]), places, [starts["prefix"], starts["middle"], starts["suffix"]])]


def _draws(doc_id: Column, seed: int) -> Column:
    """Four unsigned 32-bit numbers that depend on seed and doc_id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])


def _sampler(rate: int, spm_share: int):
    @F.arrow_udf(_SAMPLE)
    def sample(texts: pa.Array, draws: pa.Array) -> pa.Array:
        offsets, data = _bytes_of(texts)
        draw = draws.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
        out: list[list[pa.Array]] = [[] for _ in range(5)]
        for rows in _blocks(offsets):
            own = offsets[rows.start : rows.stop + 1] - offsets[rows.start]
            part, h = data[offsets[rows.start] : offsets[rows.stop]], draw[rows].T
            n, cuts = _token_cuts(own, part, [h[0], h[1]])
            plain = (np.diff(own) == 0) | (h[2] % 100 >= rate)
            plain[_marks_in(own, part)[0]] = True
            forms = np.where(plain, 0, np.where(h[3] % 100 < spm_share, 1, 2))
            chars = np.r_[0, np.cumsum((part & 0xC0) != 0x80)]
            low, high = chars[cuts.min(axis=0)], chars[cuts.max(axis=0)]
            columns = [
                pa.array(n, pa.int64()),
                pa.array(np.array(FORMS)[forms].tolist(), pa.string()),
                pa.array(low - chars[own[:-1]], pa.int64(), mask=plain),
                pa.array(high - low, pa.int64(), mask=plain),
                _strings(*scatter(own, part, cuts, forms)),
            ]
            for held, column in zip(out, columns, strict=True):
                held.append(column)
        names = [c.split()[0] for c in _SAMPLE.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.StructArray.from_arrays([pa.concat_arrays(c) if c else pa.array([], k) for c, k in zip(out, kinds, strict=True)], names)

    return sample


@F.arrow_udf(StringType())
def _restored(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    offsets, data = _bytes_of(outputs)
    code = np.array([FORMS.index(f) for f in forms.to_pylist()], np.int64)
    out = []
    for rows in _blocks(offsets):
        own = offsets[rows.start : rows.stop + 1] - offsets[rows.start]
        out.append(_strings(*gather(own, data[offsets[rows.start] : offsets[rows.stop]], code[rows])))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def infill_documents(documents: DataFrame, seed: int = 42, rate: int = 50, spm_share: int = 80) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)``, one row for each row of documents ``(doc_id, text)``.

    Documents are pages as ``render_pages`` gives them.  A text is cut after two whole tokens (a word
    with the white space before it; white space at the end is a token), chosen by a hash of
    ``seed`` and doc_id, into prefix, middle and suffix.  ``rate`` of 100 documents change form, of these
    ``spm_share`` of 100 to ``spm`` (``<S>`` suffix ``<P>`` prefix ``<M>`` middle), the rest to
    ``psm`` (``<P>`` prefix ``<S>`` suffix ``<M>`` middle).  ``n`` counts tokens, ``prefix_chars`` and
    ``middle_chars`` code points; both are null in the form ``plain``, which is the text as it is.

    Empty and null texts, and those that hold one of the marks themselves, are always plain.  A
    null doc_id draws as an empty one does; rows that repeat a doc_id are cut by the same
    draws, equal rows alike.  Other columns are ignored, whatever their names.  An empty table gives an empty one.

    Rows stay where they are: no shuffle.  A batch's bytes move by one scatter, in blocks of about 4 MB or one text.
    """
    rows = small_batches(documents).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _draws(F.col("doc_id"), seed).alias("draws"))
    return rows.select("doc_id", _sampler(rate, spm_share)("text", "draws").alias("s")).select("doc_id", "s.*")


def restore_documents(samples: DataFrame) -> DataFrame:
    """Samples ``(doc_id, form, output)`` with ``text``: the inverse of ``infill_documents``, by the marks in the output.

    A null output is the empty text of a plain row, a null form is plain.  All columns stay; one
    that is called text gives way.  An output whose marks do not fit its form ends the job with an error.
    """
    form, output = F.coalesce("form", F.lit(PLAIN)), F.coalesce("output", F.lit(""))
    return small_batches(samples).withColumn("text", _restored(output, form))
