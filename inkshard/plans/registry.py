"""Named queries over the benchmark tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Plan(NamedTuple):
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


PLANS: dict[str, Plan] = {}


def plan(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is None where SQL cannot say it on whole tables."""

    def add(fn):
        if name in PLANS:
            raise ValueError(f"query {name} registered twice")
        PLANS[name] = Plan(fn, oracle)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
