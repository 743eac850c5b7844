"""Ordered concatenation of row texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from inkshard.operators.ordered import over_groups

#: Positions in a part of a text.
PART = 65_536


def join_text(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, sep: str = "", part: int = PART) -> DataFrame:
    """``(keys, part, text, n)``: texts of a group joined in order.

    Part p holds the rows at positions (the first order column) from p x ``part`` on, so a long text
    comes in parts of bounded size; ``sep`` stands between rows and between parts.
    """
    rows = df.select(*keys, *order, text)
    out = over_groups(rows, keys, order, lambda df, scan: scan.joined_text(df, text, sep), chunk=part)
    return out.select(*keys, "part", "text", "n")
