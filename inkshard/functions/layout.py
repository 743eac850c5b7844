"""Page, slide and table geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkshard.functions import constants as K
from inkshard.functions.text import col, lookup


def strict(value: Column, key: Column, message: str) -> Column:
    """The value, or a query error when a given key has none."""
    return F.when(value.isNull() & key.isNotNull(), F.raise_error(F.concat(F.lit(message + ": "), key))).otherwise(value)


def _dims(table) -> dict:
    return {k: F.struct(F.lit(w).cast("int").alias("w"), F.lit(h).cast("int").alias("h")) for k, (w, h) in table.items()}


def _lookup_dims(key: Column, table) -> Column:
    pairs = [x for k, v in _dims(table).items() for x in (F.lit(k), v)]
    return F.try_element_at(F.create_map(*pairs), F.upper(key))


def paper_dims(paper: Column | str) -> Column:
    """``struct(w, h)`` in twips, portrait; unknown names are an error."""
    p = col(paper)
    return strict(_lookup_dims(p, K.PAPER_TWIPS), p, "Unsupported paper size")


def page_size(paper: Column | str, orientation: Column | str, w: Column | str, h: Column | str, orient: Column | str) -> Column:
    """``struct(w, h, orient)`` of a section after applying a paper size and an orientation."""
    dims, o = paper_dims(paper), col(orientation)
    w0, h0, cur = col(w).cast("int"), col(h).cast("int"), col(orient)
    keep_turned = o.isNull() & (cur == "landscape")
    w1 = F.when(dims.isNull(), w0).when(keep_turned, dims["h"]).otherwise(dims["w"])
    h1 = F.when(dims.isNull(), h0).when(keep_turned, dims["w"]).otherwise(dims["h"])
    letter_w, letter_h = K.PAPER_TWIPS["LETTER"]
    missing = w1.isNull() & h1.isNull()
    w2 = F.when(missing, F.lit(letter_w)).otherwise(F.coalesce(w1, F.lit(0)))
    h2 = F.when(missing, F.lit(letter_h)).otherwise(F.coalesce(h1, F.lit(0)))
    wants = F.lower(o) == "landscape"
    swap = (w2 > h2) != wants
    return F.struct(
        F.when(o.isNull(), w1).when(swap, h2).otherwise(w2).cast("int").alias("w"),
        F.when(o.isNull(), h1).when(swap, w2).otherwise(h2).cast("int").alias("h"),
        F.when(o.isNull(), cur).when(wants, F.lit("landscape")).alias("orient"),
    )


def slide_size(name: Column | str) -> Column:
    """``struct(w, h)`` in EMU; null keeps the deck as it is, unknown names are an error."""
    n = col(name)
    emu = {k: (int(w * K.EMU_PER_INCH), int(h * K.EMU_PER_INCH)) for k, (w, h) in K.SLIDE_INCHES.items()}
    return strict(_lookup_dims(n, emu), n, "Unsupported slide size")


def content_width_emu(page: Column, left: Column, right: Column) -> Column:
    pick = lambda c, d: F.coalesce(F.nullif(c.cast("bigint"), F.lit(0).cast("bigint")), F.lit(d).cast("bigint"))
    return pick(page, K.LETTER_WIDTH_EMU) - pick(left, K.SIDE_MARGIN_EMU) - pick(right, K.SIDE_MARGIN_EMU)


def clamp_twips(width: Column, max_emu: Column) -> Column:
    """A width in twips cut to the available EMU; no limit when that is not positive."""
    w = width.cast("bigint")
    return F.when(max_emu > 0, F.least(w, F.floor(max_emu / K.EMU_PER_TWIP))).otherwise(w)


def apply_layout(existing_type: Column, existing_w: Column, layout: Column, max_emu: Column) -> Column:
    """Final table properties from what the table has and the layout recovered for it."""
    has_width = F.coalesce(layout["width_type"].isNotNull() & layout["width_value"].isNotNull(), F.lit(False))
    keeps = ~has_width & F.coalesce((existing_type == "dxa") & (existing_w > 0), F.lit(False))
    fixed = has_width & (layout["width_type"] == "dxa")
    width = (
        F.when(keeps, clamp_twips(existing_w, max_emu))
        .when(fixed, clamp_twips(layout["width_value"], max_emu))
        .when(has_width, layout["width_value"].cast("bigint"))
        .otherwise(F.lit(K.FULL_WIDTH_PCT).cast("bigint"))
    )
    return F.struct(
        width.alias("width"),
        F.when(keeps, existing_type).when(has_width, layout["width_type"]).otherwise("pct").alias("width_type"),
        F.when(keeps, F.lit(None).cast("string")).when(fixed, "fixed").otherwise("autofit").alias("layout_type"),
        F.when(~keeps, layout["jc"]).alias("jc"),
        F.when(~keeps, layout["indent_twips"]).alias("indent_twips"),
    )


def table_line_fraction(width_type: Column | str, value: Column | str, jc: Column | str) -> Column:
    """``struct(tw, absolute, ta)``: width as a share of the line, four digits, and the side."""
    kind, n = col(width_type), col(value).try_cast("double")
    share = F.when(n > 0, F.when(kind == "pct", n / K.FULL_WIDTH_PCT).when(kind == "dxa", n / K.LINE_TWIPS))
    share = F.when(share.isNotNull(), F.least(share, F.lit(1.0)))
    return F.struct(
        F.when(share.isNotNull(), F.format_string("%.4f", share)).alias("tw"),
        F.coalesce(share.isNotNull() & (kind == "dxa"), F.lit(False)).alias("absolute"),
        lookup(F.lower(col(jc)), K.JC_TO_ALIGN).alias("ta"),
    )
