"""Colour normalisers.  Each context has its own rules; they are deliberately separate."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkshard.functions import constants as K
from inkshard.functions.text import col, let, lookup

_HEX6 = r"^#?([0-9A-Fa-f]{6})$"
_HEX3 = r"^#?([0-9A-Fa-f])([0-9A-Fa-f])([0-9A-Fa-f])$"
_RGB = r"^rgb\((\d+),(\d+),(\d+)\)$"


def _hex6_or_3(v: Column) -> Column:
    return F.when(v.rlike(_HEX6), F.upper(F.regexp_extract(v, _HEX6, 1))).when(v.rlike(_HEX3), F.upper(F.regexp_replace(v, _HEX3, "$1$1$2$2$3$3")))


def css_hex(value: Column | str) -> Column:
    """``#RGB``, ``#RRGGBB`` (hash optional) or ``rgb()`` with any spaces, as ``RRGGBB``."""
    def parse(v: Column) -> Column:
        part = lambda i: F.regexp_extract(v, _RGB, i).try_cast("bigint")
        return F.coalesce(_hex6_or_3(v), F.when(v.rlike(_RGB), F.format_string("%02X%02X%02X", part(1), part(2), part(3))))

    return let(F.regexp_replace(col(value), r"\s+", ""), parse)


def named_hex(value: Column | str, names: Mapping[str, str]) -> Column:
    return lookup(F.lower(col(value)), names)


def run_hex(value: Column | str) -> Column:
    """Colour of a run: six hex digits; ``auto`` and theme names mean none."""
    return F.nullif(F.upper(F.regexp_extract(col(value), r"^\s*#?([0-9A-Fa-f]{6})\s*$", 1)), F.lit(""))


def cell_hex(value: Column | str) -> Column:
    """Fill of a cell: as for runs, white means none."""
    return F.nullif(run_hex(value), F.lit("FFFFFF"))


def math_hex(model: Column | str, value: Column | str) -> Column:
    """Colour of a formula: hex or a name without a model, hex only with ``HTML``, else none."""
    v, m = col(value), F.coalesce(col(model), F.lit(""))
    return F.when(m == "", F.coalesce(_hex6_or_3(v), named_hex(v, K.MATH_COLORS))).when(F.lower(m) == "html", _hex6_or_3(v))


def border_hex(value: Column | str) -> Column:
    return F.coalesce(css_hex(value), named_hex(value, K.BORDER_COLORS))
