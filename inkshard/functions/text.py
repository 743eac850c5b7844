"""Small string helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column) -> Column:
    """Trim white space of any kind from both ends."""
    return F.btrim(c, F.lit(" \t\n\r\f\v"))


def let(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once, also inside lambdas, where Spark shares nothing."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def lookup(key: Column, table: Mapping) -> Column:
    """Value of a small fixed table, null when the key is not in it."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def one_of(c: Column, values) -> Column:
    return c.isin(list(values))


def half_even(c: Column) -> Column:
    return F.bround(c, 0).cast("bigint")


def half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5)).cast("bigint")


def first(arr: Column) -> Column:
    return F.get(arr, F.lit(0))


def group(c: Column, pattern: str, index: int) -> Column:
    """A regex group, null when the pattern does not match or the group is empty."""
    return F.nullif(F.regexp_extract(c, pattern, index), F.lit(""))


def escape_xml(c: Column | str) -> Column:
    out = col(c)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def error_line(c: Column | str) -> Column:
    """A message on one line, for log output."""
    return F.regexp_replace(col(c), r"\r?\n", "")


def in_range_or_default(value: Column, lo: float, hi: float, default: float, kind: str = "int") -> Column:
    number = value.try_cast(kind)
    return F.when(number.between(lo, hi), number).otherwise(F.lit(default).cast(kind))
