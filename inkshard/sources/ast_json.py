"""Block trees as JSON, out and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkshard.operators.text import join_text

_BLOCKS = "array<struct<kind:string,level:int,text:string>>"


def write_ast_json(blocks: DataFrame, **limits) -> DataFrame:
    """``(doc_id, part, json)``: a document's blocks as a JSON array, in parts when it is huge."""
    rows = blocks.select("doc_id", "pos", F.to_json(F.struct("kind", "level", "text")).alias("_j"))
    out = join_text(rows, ["doc_id"], ["pos"], "_j", sep=",", **limits)
    return out.select("doc_id", "part", F.concat(F.lit("["), F.col("text"), F.lit("]")).alias("json"))


def read_ast_json(docs: DataFrame) -> DataFrame:
    """Block rows of ``(doc_id, part, json)``; positions count within a part."""
    return docs.select("doc_id", "part", F.posexplode(F.from_json("json", _BLOCKS)).alias("pos", "b")).select("doc_id", "part", "pos", "b.*")
