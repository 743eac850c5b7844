"""One named output file for each document and target, written through a data source with commit and abort."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from inkshard.functions.text import col
from inkshard.sources.dims import output_name
from inkshard.sources.trees import opened

# Folders that hold the documents' own folders.
BUCKETS = 256


def file_of(doc_id: Column | str, target: Column | str, buckets: int = BUCKETS) -> Column:
    """Where the output of a document for a target lies below the folder of a write; a null doc_id is called ``null``."""
    doc, name = F.coalesce(col(doc_id).cast("string"), F.lit("null")), F.coalesce(col(target), F.lit("null"))
    bucket = F.lpad(F.pmod(F.xxhash64(doc), F.lit(buckets)).cast("string"), 6, "0")
    # Readers hide names that start with _ or ., and a dot alone is no name.
    plain = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("_"), F.lit("%5F")), F.lit("."), F.lit("%2E"))
    return F.concat_ws("/", F.concat(F.lit("b"), bucket), plain(doc), plain(name), output_name(target))


@dataclass
class _Written(WriterCommitMessage):
    folder: str | None


class _Writer(DataSourceWriter):
    """A task writes below a staging folder of its attempt, so attempts that are lost or run twice never meet.

    Commit moves the buckets of the attempts that count together and puts the whole in the place of what
    stood under the path; abort, or a job that dies, leaves the old files as they were.
    Messages name a folder for each task, not files.
    """

    def __init__(self, path: str):
        self.path, self.staging = path, f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        files, root = opened(f"{self.staging}/{uuid.uuid4().hex}")
        out, name = None, None
        for row in rows:
            if row.file != name:
                if out is not None:
                    out.close()
                name = row.file
                files.create_dir(f"{root}/{name.rpartition('/')[0]}", recursive=True)
                out = files.open_output_stream(f"{root}/{name}")
            out.write((row.text or "").encode())
        if out is not None:
            out.close()
        return _Written(root if out is not None else None)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, path = opened(self.path)
        _, staging = opened(self.staging)
        whole = f"{staging}/whole"
        files.create_dir(whole, recursive=True)
        for message in messages:
            if message is not None and message.folder is not None:
                # A bucket is written by one task, so nothing is merged.
                for bucket in files.get_file_info(fs.FileSelector(message.folder)):
                    files.move(bucket.path, f"{whole}/{bucket.base_name}")
        if files.get_file_info(path).type != fs.FileType.NotFound:
            files.move(path, f"{staging}/old")
        files.move(whole, path)
        files.delete_dir(staging)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, staging = opened(self.staging)
        if files.get_file_info(staging).type != fs.FileType.NotFound:
            files.delete_dir(staging)


class DocumentFiles(DataSource):
    """Format ``document_files``: rows ``(file, text)``, those of a file behind each other, below the option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "file string, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if not overwrite:
            raise ValueError("document_files replaces what its path holds: use mode overwrite, and a path for each batch")
        return _Writer(self.options["path"])


def write_documents(df: DataFrame, path: str, target: str = "target_format", buckets: int = BUCKETS) -> None:
    """Write ``(doc_id, part, text)`` and the column ``target``: one file for each document and target, parts joined in order.

    What ``path`` held is replaced as a whole when all tasks are done, so writing again leaves one copy and
    a job that fails leaves the old one.  Documents are shuffled to their buckets; a file has one order, so a document
    is one task, which streams it.  Null texts count as empty; of several rows with the same part all are
    written.  An empty table leaves an empty folder; other columns are ignored.  ``path`` is a folder that driver and executors
    share, on a file system that renames folders.
    """
    spark = df.sparkSession
    spark.dataSource.register(DocumentFiles)
    named = df.select(file_of("doc_id", target, buckets).alias("file"), "part", "text").withColumn("_bucket", F.substring_index("file", "/", 1))
    placed = named.repartition("_bucket").sortWithinPartitions("file", "part").select("file", "text")
    placed.write.format("document_files").mode("overwrite").option("path", path).save()


def read_documents(spark: SparkSession, path: str, target: str | None = None) -> DataFrame:
    """``(doc_id, target_format, file_name, text)`` of a folder of ``write_documents``, or of one target in it; doc_id as text.

    As with Spark's readers, files without bytes, those of empty documents, give no row.  Buckets are listed and read by tasks.
    """
    from inkshard.sources.corpus import read_corpus

    at = F.split("path", "/")
    name = lambda k: F.url_decode(F.url_decode(F.element_at(at, k)))
    found = read_corpus(spark, path, "txt", nested=True, where=None if target is None else name(-2) == target)
    return found.select(name(-3).alias("doc_id"), name(-2).alias("target_format"), F.element_at(at, -1).alias("file_name"), F.col("body").alias("text"))
