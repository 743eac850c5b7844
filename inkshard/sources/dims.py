"""Formats, MIME types, extensions and sizes as small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkshard.functions import constants as K
from inkshard.functions.text import col, lookup


def formats_dim(spark: SparkSession) -> DataFrame:
    names = sorted({*K.SOURCE_FORMATS, *K.TARGET_FORMATS})
    rows = [(n, n in K.SOURCE_FORMATS, n in K.TARGET_FORMATS) for n in names]
    return spark.createDataFrame(rows, "format string, is_source boolean, is_target boolean")


def mime_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.MIME_TYPES.items()), "format string, mime_type string")


def ext_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.FILE_EXTENSIONS.items()), "format string, extension string")


def paper_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in K.PAPER_TWIPS.items()], "paper string, w int, h int")


def unsupported_formats(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Each ``format`` of two lists and the side it is on: source_only, target_only or both; lists may repeat."""
    side = lambda df, name: df.groupBy("format").agg(F.lit(True).alias(name))
    both = side(sources, "_s").join(side(targets, "_t"), "format", "full_outer")
    return both.select("format", F.when(F.col("_s") & F.col("_t"), "both").when(F.col("_s"), "source_only").otherwise("target_only").alias("side"))


def mime_type(fmt: Column | str) -> Column:
    return F.coalesce(lookup(col(fmt), K.MIME_TYPES), F.lit(K.DEFAULT_MIME_TYPE))


def output_name(fmt: Column | str) -> Column:
    return F.concat(F.lit("converted-document."), F.coalesce(lookup(col(fmt), K.FILE_EXTENSIONS), F.lit(K.DEFAULT_EXTENSION)))


def lookup_dim(df: DataFrame, dim: DataFrame, key: str, dim_key: str, strict: bool = False) -> DataFrame:
    """Left join with a small fixed table on the upper-cased key; ``strict`` fails the query on unknown keys.

    ``dim`` must be one of the fixed tables of this module (at most 27 rows), which is why it is broadcast.
    """
    right = dim.withColumn("_k", F.upper(dim_key)).withColumn("_hit", F.lit(True)).drop(dim_key)
    out = df.withColumn("_k", F.upper(F.col(key))).join(F.broadcast(right), "_k", "left")
    if strict:
        bad = F.col("_hit").isNull() & F.col(key).isNotNull()
        out = out.withColumn(key, F.when(bad, F.raise_error(F.concat(F.lit("Unsupported value: "), F.col(key)))).otherwise(F.col(key)))
    return out.drop("_k", "_hit")
