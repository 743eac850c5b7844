"""Images and drawings: data URIs, pixel sizes, drawing sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkshard.functions import constants as K
from inkshard.functions.css import clamp_scale, css_px, css_value
from inkshard.functions.text import col, lookup

_HEADER_BASE64 = 65536 * 4 // 3 + 4


def data_url(src: Column | str) -> Column:
    """``struct(content_type, payload)`` of a base64 data URI, else null."""
    s = col(src)
    ok = s.startswith("data:") & s.contains(";base64,")
    at = F.instr(s, ";base64,")
    return F.when(ok, F.struct(F.substr(s, F.lit(6), at - 6).alias("content_type"), F.substr(s, at + 8).alias("payload")))


def svg_source(src: Column | str) -> Column:
    """Drawing text of a data URI; a wrong type is tolerated unless it names a raster format."""
    parsed = data_url(src)
    raw = F.try_to_binary(parsed["payload"], F.lit("base64"))
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    return F.when(~parsed["content_type"].isin("image/jpeg", "image/png", "image/gif") & (F.instr(text, "\x00") == 0), text)


def raster_size(data_uri: Column | str) -> Column:
    """``struct(width, height)`` of a PNG, GIF or BMP, reading only the head of the payload."""
    s = col(data_uri)
    head = F.substring_index(s, ",", 1)
    payload = F.substr(s, F.instr(s, ",") + 1, F.lit(_HEADER_BASE64))
    whole = F.substr(payload, F.lit(1), (F.floor(F.length(payload) / 4) * 4).cast("int"))
    hexed = F.hex(F.substring(F.try_to_binary(whole, F.lit("base64")), 1, 26))

    def big(at: int, n: int) -> Column:
        return F.conv(F.substring(hexed, at * 2 + 1, n * 2), 16, 10).cast("bigint")

    def little(at: int, n: int) -> Column:
        parts = [F.substring(hexed, (at + i) * 2 + 1, 2) for i in reversed(range(n))]
        return F.conv(F.concat(*parts), 16, 10).cast("bigint")

    def signed(x: Column) -> Column:
        return F.abs(F.when(x >= 2**31, x - 2**32).otherwise(x))

    size = lambda w, h: F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))
    n = F.length(hexed) / 2
    found = (
        F.when(hexed.startswith("89504E470D0A1A0A") & (n >= 24), size(big(16, 4), big(20, 4)))
        .when((hexed.startswith("474946383761") | hexed.startswith("474946383961")) & (n >= 10), size(little(6, 2), little(8, 2)))
        .when(hexed.startswith("424D") & (n >= 26), size(signed(little(18, 4)), signed(little(22, 4))))
    )
    return F.when(s.startswith("data:") & ~head.contains("svg") & head.contains("base64"), found)


def sized_image(src: Column, style: Column, width: Column, height: Column) -> Column:
    """Pixel size to give an image that states none, else null."""
    empty = lambda c: c.isNull() | (c == "")
    unsized = empty(width) & empty(height) & css_value(style, "width", "last_lower").isNull() & css_value(style, "height", "last_lower").isNull()
    unsized = unsized | (empty(width) & empty(height) & style.isNull())
    size = raster_size(src)
    fitted = clamp_scale(size["width"], size["height"], css_px(css_value(style, "max-width", "last_lower")), css_px(css_value(style, "max-height", "last_lower")))
    return F.when(unsized & size.isNotNull(), fitted)


def svg_size_px(width: Column | str, height: Column | str, view_box: Column | str) -> Column:
    """``struct(width, height, error)`` of a drawing in pixels, rounded up."""
    parts = F.split(F.regexp_replace(F.trim(F.replace(col(view_box), F.lit(","), F.lit(" "))), r"\s+", " "), " ")
    vb_w = F.get(parts, F.lit(2)).try_cast("double")
    vb_h = F.get(parts, F.lit(3)).try_cast("double")
    vb_ok = (F.size(parts) == 4) & vb_w.isNotNull() & vb_h.isNotNull()
    vb_w, vb_h = F.when(vb_ok, vb_w), F.when(vb_ok, vb_h)
    pattern = r"^(-?\d+(?:\.\d+)?)([A-Za-z%]*)$"

    def side(value: Column, vb: Column) -> tuple[Column, Column]:
        number = F.regexp_extract(value, pattern, 1).try_cast("double")
        unit = F.regexp_extract(value, pattern, 2)
        relative = number.isNotNull() & unit.isin("vw", "vh", "%")
        px = F.when(relative, number / 100 * vb).otherwise(number * F.coalesce(lookup(unit, K.SVG_PX_PER_UNIT), F.lit(1.0)))
        return F.ceil(px).cast("int"), F.when(relative & vb.isNull(), F.concat(unit, F.lit(" units require a viewBox to be defined")))

    (w, w_err), (h, h_err) = side(col(width), vb_w), side(col(height), vb_h)
    w, h = F.coalesce(w, F.ceil(vb_w).cast("int")), F.coalesce(h, F.ceil(vb_h).cast("int"))
    error = F.coalesce(w_err, h_err)
    both = w.isNotNull() & h.isNotNull() & error.isNull()
    return F.struct(F.when(both, w).alias("width"), F.when(both, h).alias("height"), error.alias("error"))


def svg_img_width(style: Column | str, width: Column) -> Column:
    """Style of a rasterised image: its own width and height give way to the drawing's width."""
    trimmed = F.transform(F.split(F.coalesce(col(style), F.lit("")), ";"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    kept = F.filter(trimmed, lambda p: (p != "") & ~F.lower(p).startswith("width:") & ~F.lower(p).startswith("height:"))
    return F.array_join(F.array_append(kept, F.concat(F.lit("width: "), width.cast("string"), F.lit("px"))), "; ")


def svg_data_uri(svg: Column | str) -> Column:
    return F.concat(F.lit("data:image/svg+xml;base64,"), F.base64(F.encode(col(svg), "UTF-8")))
