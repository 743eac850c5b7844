"""All files below a folder, listed and read by tasks; the driver holds a row for some thousand files, not one for each."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession

# A stretch ends with the file that reaches one of these, and so does a batch of bodies.
STRETCH_FILES, STRETCH_BYTES = 4_096, 64 << 20
BATCH_BYTES = 4 << 20

# Spark's reader of text unpacks files of these names.
PACKED = (".bz2", ".deflate", ".gz", ".lz4", ".snappy", ".zst")

Place = tuple[str, ...]


class Stretch(NamedTuple):
    """Files that follow each other below a folder, or directly in it if not ``deep``; places are names from the folder down."""

    folder: str
    deep: bool
    first: Place
    last: Place
    n_files: int
    n_bytes: int
    packed: bool


def opened(path: str) -> tuple[fs.FileSystem, str]:
    plain = path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
    return fs.FileSystem.from_uri(plain)


def _hidden(entry: fs.FileInfo) -> bool:
    """As Spark's readers pass over files and folders."""
    name = entry.base_name
    odd = name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")
    return odd and not (entry.type == fs.FileType.Directory and name.startswith(("_common_metadata", "_metadata")))


def _entries(files: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    return sorted((e for e in files.get_file_info(fs.FileSelector(folder)) if not _hidden(e)), key=lambda e: e.base_name)


def _below(files: fs.FileSystem, folder: str, deep: bool = True, first: Place = (), last: Place | None = None, at: Place = ()) -> Iterator[tuple[Place, int]]:
    """Places and sizes of the files with bytes, in the order of places from ``first`` to ``last``; one listing of a folder at each level is held."""
    for entry in _entries(files, folder):
        place = (*at, entry.base_name)
        if last is not None and place > last:
            return
        if place < first[: len(place)]:
            continue
        if entry.type != fs.FileType.Directory:
            if entry.size:
                yield place, entry.size
        elif deep:
            yield from _below(files, entry.path, deep, first, last, place)


def _stretches(folder: str, deep: bool, found: Iterable[tuple[Place, int]]) -> Iterator[Stretch]:
    first, last, n, size, packed = None, None, 0, 0, False
    for last, k in found:
        first, n, size, packed = first or last, n + 1, size + k, packed or last[-1].endswith(PACKED)
        if n >= STRETCH_FILES or size >= STRETCH_BYTES:
            yield Stretch(folder, deep, first, last, n, size, packed)
            first, n, size, packed = None, 0, 0, False
    if n:
        yield Stretch(folder, deep, first, last, n, size, packed)


def _as_uri(name: str) -> str:
    """A name as java.net.URI quotes it in a path: letters beyond ASCII stay, spaces and controls do not."""
    return "".join(c if c > "\x7f" and unicodedata.category(c) not in ("Zs", "Zl", "Zp", "Cc") else quote(c, safe="-_.!~*'():@&=+$,;") for c in name)


def _files_of(root: str, shown: str, as_uri: bool, stretch: Stretch) -> Iterator[tuple[str, str]]:
    """Each file of a stretch: where it is opened, and its path as Spark's readers give it."""
    files, at = opened(root)
    below = f"{at}/{stretch.folder}".rstrip("/")
    n = size = 0
    for place, k in _below(files, below, stretch.deep, stretch.first, stretch.last):
        n, size = n + 1, size + k
        names = (stretch.folder, *place) if stretch.folder else place
        yield f"{below}/{'/'.join(place)}", f"{shown}/{'/'.join(map(_as_uri, names) if as_uri else names)}"
    if (n, size) != (stretch.n_files, stretch.n_bytes):
        raise RuntimeError(f"files below {below} changed after they were listed: {stretch.n_files} files of {stretch.n_bytes} bytes, now {n} of {size}")


def _bodies(root: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    files, _ = opened(root)
    for batch in batches:
        paths, bodies, size = [], [], 0
        for file, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            with files.open_input_file(file) as f:
                bodies.append(f.readall())
            paths.append(path)
            size += len(bodies[-1])
            if size >= BATCH_BYTES:
                yield pa.record_batch([pa.array(paths, pa.string()), pa.array(bodies, pa.binary())], ["path", "body"])
                paths, bodies, size = [], [], 0
        if paths:
            yield pa.record_batch([pa.array(paths, pa.string()), pa.array(bodies, pa.binary())], ["path", "body"])


def read_tree(spark: SparkSession, path: str, text: bool, where: Column | None = None) -> DataFrame | None:
    """``(path, body)`` with bytes of all files below a folder, as Spark's readers of text or of bytes would give them.

    ``where`` is a condition on ``path``; other files are not opened.  The folder itself is listed here, its own folders by
    tasks, which return stretches of files; later tasks list a stretch again and fail if it is no longer the same.  None
    where this does not hold: patterns, single files, file systems that Arrow does not open, and texts among which are packed ones.
    """
    if any(c in path for c in "{}[]*?\\"):
        return None
    sc = spark.sparkContext
    named = sc._jvm.org.apache.hadoop.fs.Path
    whole = named(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(named(path)).toString()
    root, shown = whole.rstrip("/"), (named(whole).toUri().toString() if text else whole).rstrip("/")
    try:
        files, at = opened(root)
        top = _entries(files, at)
    except (pa.ArrowException, OSError):
        return None

    def of_folder(name: str) -> list[Stretch]:
        files, at = opened(root)
        return list(_stretches(name, True, _below(files, f"{at}/{name}")))

    folders = [e.base_name for e in top if e.type == fs.FileType.Directory]
    stretches = list(_stretches("", False, (((e.base_name,), e.size) for e in top if e.type != fs.FileType.Directory and e.size)))
    if folders:
        stretches += sc.parallelize(folders, min(len(folders), 10_000)).flatMap(of_folder).collect()
    if text and any(s.packed for s in stretches):
        return None
    full = sum(max(s.n_files / STRETCH_FILES, s.n_bytes / STRETCH_BYTES) for s in stretches)
    tasks = max(1, min(len(stretches), max(sc.defaultParallelism, math.ceil(full))))
    found = sc.parallelize(stretches, tasks).flatMap(lambda s: _files_of(root, shown, text, s))
    found = spark.createDataFrame(found, "file string, path string", verifySchema=False)
    found = found if where is None else found.filter(where)
    return found.mapInArrow(lambda batches: _bodies(root, batches), "path string, body binary")
