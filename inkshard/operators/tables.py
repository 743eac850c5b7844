"""Tables: layouts, grids, columns and cells."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from inkshard.functions import constants as K
from inkshard.functions.css import css_map
from inkshard.functions.text import half_even
from inkshard.operators.ordered import CHUNK, Scan, over_groups
from inkshard.session import written


def table_ordinals(tables: DataFrame, order: Sequence[str], **limits) -> DataFrame:
    """Running number of each table in its document."""
    return over_groups(tables, ["doc_id"], order, lambda df, scan: scan.ordinal(df, "ordinal"), **limits)


def apply_table_layouts(layouts: DataFrame, tables: DataFrame, **limits) -> DataFrame:
    """Tables with the layout of the same ordinal, provided both sides count the same.

    Both sides need ``(doc_id, ordinal)``.  A document's counts differ exactly when the
    full join leaves a row without partner, so no document is ever counted in one task.
    """
    left = layouts.withColumn("_has_layout", F.lit(True))
    right = tables.withColumn("_has_table", F.lit(True))
    both = left.join(right, ["doc_id", "ordinal"], "full_outer")
    odd = F.col("_has_layout").isNull() | F.col("_has_table").isNull()
    out = over_groups(both, ["doc_id"], ["ordinal"], lambda df, scan: scan.totals(df, _odd=("max", odd)), **limits)
    fields = [c for c in layouts.columns if c not in ("doc_id", "ordinal")]
    out = out.filter(F.col("_has_table")).withColumns({c: F.when(~F.col("_odd"), F.col(c)) for c in fields})
    return out.withColumn("matched", ~F.col("_odd")).drop("_odd", "_has_layout", "_has_table")


def table_columns(cells: DataFrame, keys: Sequence[str] = ("table_id",), row: str = "row", span: str = "grid_span") -> DataFrame:
    """Columns each table needs: the widest row's sum of spans; a bad span counts 1."""
    n = F.col(span).try_cast("int")
    wide = F.when(n > 0, n).otherwise(F.lit(1))
    return cells.groupBy(*keys, row).agg(F.sum(wide).alias("n")).groupBy(*keys).agg(F.max("n").cast("int").alias("n_cols"))


def rescale_grid(cols: DataFrame, target: str = "target_twips", keys: Sequence[str] = ("table_id",), order: str = "col", **limits) -> DataFrame:
    """Column widths scaled to sum to the target; a grid without width is split evenly."""
    out = over_groups(cols, list(keys), [order], lambda df, scan: scan.totals(df, _sum=("sum", F.col("w").cast("bigint")), _n=("sum", F.lit(1))), **limits)
    even = F.floor(F.col(target) / F.col("_n"))
    scaled = half_even(F.col("w").cast("bigint") * F.col(target) / F.nullif(F.col("_sum"), F.lit(0)))
    return out.withColumn("new_w", F.greatest(F.lit(1), F.when(F.col("_sum") <= 0, even).otherwise(scaled)).cast("bigint")).drop("_sum", "_n")


def column_fractions(cols: DataFrame, tw: str = "tw", keys: Sequence[str] = ("table_id",), order: str = "col", **limits) -> DataFrame:
    """Share of the line each column takes; ``w`` is a relative width or null."""
    w = F.col("w").cast("double")
    whole = {"_n": ("sum", F.lit(1)), "_given": ("sum", w), "_bare": ("sum", w.isNull().cast("int"))}
    out = over_groups(cols, list(keys), [order], lambda df, scan: scan.totals(df, **whole), **limits)
    share = F.coalesce(w, 1.0 / F.col("_n"))
    total = F.coalesce("_given", F.lit(0.0)) + F.col("_bare") / F.col("_n")
    return out.withColumn("fraction", share / F.when(total <= 0, 1.0).otherwise(total) * F.col(tw)).drop(*whole)


def default_grid(cols: DataFrame, needed: DataFrame, keys: Sequence[str] = ("table_id",)) -> DataFrame:
    """A positive width for every column a table needs: 4800 where it is missing or unusable.

    ``needed`` has ``n_cols`` per table; columns beyond it that exist are kept.
    """
    wanted = needed.select(*keys, F.explode(F.sequence(F.lit(1), F.col("n_cols"))).alias("col"))
    n = F.col("w").try_cast("int")
    out = wanted.join(cols.select(*keys, F.col("col").cast("int").alias("col"), "w"), [*keys, "col"], "full_outer")
    return out.select(*keys, "col", F.when(n > 0, n).otherwise(F.lit(K.DEFAULT_GRID_TWIPS)).alias("w"))


def tables_with_cell_styles(cells: DataFrame, keys: Sequence[str] = ("doc_id", "table_pos"), style: str = "style", enabled: bool = True) -> DataFrame:
    """Tables to rebuild: those with any styled cell, and only when asked for."""
    return cells.groupBy(*keys).agg(F.bool_or(F.col(style).isNotNull()).alias("_s")).filter(F.col("_s") & F.lit(enabled)).drop("_s")


def table_grid(cells: DataFrame, keys: Sequence[str] = ("table_id",), n_cols: str = "n_cols", chunk: int = CHUNK) -> DataFrame:
    """Logical grid of tables: cells pushed right by row spans, continuation cells included.

    Input rows are ``(keys, row, ord, row_span, col_span, style, n_cols)``.  A row that no
    span from above reaches starts afresh, so tables are first cut into such bands.
    Bands without row spans need no memory and stay in the JVM; only the others are walked in
    Python, in pieces of ``chunk`` rows.  What a piece of a band leaves to the next is the coverage of columns by
    spans that reach further down, see ``_coverage``.  A null key is a key like any other; no cells give no grid.
    """
    keys = list(keys)
    reach = F.col("row") + F.greatest(F.col("row_span"), F.lit(1)) - 1

    def bands(df: DataFrame, scan: Scan) -> DataFrame:
        df = scan.running(df, include_current=False, _reach=("max", reach))
        fresh = F.coalesce(F.col("row") > F.col("_reach"), F.lit(True))
        df = scan.running(df.withColumn("_fresh", fresh).drop("_reach"), band=("sum", F.col("_fresh").cast("int")))
        # A row lies in one chunk.  It is a band without memory if it starts one and spans no other row.
        in_row = Window.partitionBy(*scan.pieces, "row")
        memory = ~F.bool_or("_fresh").over(in_row) | (F.max("row_span").over(in_row) > 1)
        return df.withColumns({"_tall": memory, "_end": F.sum("col_span").over(in_row.orderBy("ord"))}).drop("_fresh")

    # A struct of keys equals another where both have nulls, which plain keys of a join do not.
    rows = over_groups(cells.withColumn("_group", F.struct(F.lit(0), *keys)), ["_group"], ["row", "ord"], bands, chunk)
    rows = written(rows.select(*keys, "band", "row", "ord", "row_span", "col_span", "style", n_cols, "_tall", "_end"))
    flat = rows.filter(~F.coalesce("_tall", F.lit(False)))
    flat = flat.withColumns({"grid_col": (F.col("_end") - F.col("col_span") + 1).cast("int"), "is_continuation": F.lit(False)}).filter(F.col("grid_col") <= F.col(n_cols))
    out = [*keys, "row", "grid_col", "col_span", "row_span", "is_continuation", "style"]
    flat = flat.select(*out)
    band = [*keys, "band"]
    piece = F.coalesce(F.floor(F.col("row") / F.lit(chunk)).cast("bigint"), F.lit(-1).cast("bigint"))
    tall = rows.filter("_tall").withColumn("_piece", piece).drop("_tall", "_end")
    walk = _Walk(band, n_cols)
    return flat.unionByName(walk.run(tall, _coverage(tall, walk, chunk), flat.schema, grid=True))


class _Walk:
    """Cells of a piece of a band in order, from the coverage it starts with to its grid, or to the spans of its own that reach beyond its last row.

    Memory is one entry for each column, whatever the height of a piece.
    """

    def __init__(self, band: list[str], n_cols: str):
        self.band, self.pieces, self.n_cols = band, [*band, "_piece"], n_cols

    def none(self, tall: DataFrame) -> DataFrame:
        """Coverage ``(pieces, _cover)`` of no piece."""
        style = tall.schema["style"].dataType.simpleString()
        return tall.select(*self.pieces, F.lit(None).cast(f"array<struct<col: bigint, until: bigint, span: bigint, style: {style}>>").alias("_cover")).limit(0)

    def run(self, cells: DataFrame, starts: DataFrame, schema: StructType, grid: bool) -> DataFrame:
        """Walk all pieces; a start comes in front of its piece's cells."""
        ordered = cells.unionByName(starts, allowMissingColumns=True).repartition(*self.pieces)
        ordered = ordered.sortWithinPartitions(*self.pieces, F.asc_nulls_first("row"), F.desc_nulls_last("_cover"), "ord")
        pieces, arrow = self.pieces, to_arrow_schema(schema)
        used = ("row", "col_span", "row_span", "style", self.n_cols, "_cover")

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, covered, own, at, now, here, width = [], {}, {}, 1, None, None, 0
            # Rows leave as tuples: those of the grid without the band and the piece.
            kept = len(pieces) - 2 if grid else len(pieces)

            def cell(col, span, tall, repeated, style):
                if grid:
                    found.append((*now[:kept], here, col, span, tall, repeated, style))

            def handed_on():
                columns = zip(*found) if found else ([] for _ in arrow)
                out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
                found.clear()
                return out

            def continuations():
                nonlocal at
                while here is not None and at <= width and at in covered and covered[at][0] >= here:
                    _, span, style = covered[at]
                    cell(at, span, 1, True, style)
                    at += span

            def finish():
                continuations()
                if here is not None and not grid:
                    live = [{"col": c, "until": u, "span": n, "style": s} for c, (u, n, s) in sorted(own.items()) if u > here]
                    found.append((*now, live))

            for batch in batches:
                columns = [batch.column(name).to_pylist() for name in (*pieces, *used)]
                for *key, row, col_span, row_span, style, n, cover in zip(*columns):
                    if key != now:
                        finish()
                        now, covered, own, here, at = key, {}, {}, None, 1
                    if cover is not None:
                        covered = {s["col"]: (s["until"], s["span"], s["style"]) for s in cover}
                        continue
                    if row != here:
                        continuations()
                        here, at, width = row, 1, n or 0
                    continuations()
                    if at <= width:
                        cell(at, col_span, row_span, False, style)
                        if (row_span or 1) > 1:
                            covered[at] = own[at] = here + row_span - 1, col_span or 1, style
                        at += col_span or 1
                yield handed_on()
            finish()
            yield handed_on()

        return ordered.mapInArrow(place, schema)


def _coverage(tall: DataFrame, walk: _Walk, chunk: int) -> DataFrame:
    """``(pieces, _cover)``: the coverage each piece of a band starts with, where it is not empty.

    All pieces are walked at once from no coverage; the spans of each that reach beyond it go to every piece they
    reach, and pieces whose start is another than before are walked again, until none is.  A long span is known to all
    below it after one round, so two or three rounds are the rule; a piece is right after as many rounds as there are pieces above it at
    the latest.  Bands that lie in one piece take no part.
    """
    same = lambda *names: F.struct(F.lit(0), *names)  # noqa: E731  structs of nulls are equal, nulls are not
    starts = walk.none(tall)
    ends_schema = starts.schema
    cut = tall.groupBy(*walk.band).agg(F.min("_piece").alias("_lo"), F.max("_piece").alias("_hi")).filter("_lo < _hi")
    cut = written(cut.select(same(*walk.band).alias("_b"), "_hi"))
    cells = written(tall.withColumn("_b", same(*walk.band)).join(cut, "_b", "left_semi").drop("_b"))
    again, ends = cells, None
    while not again.isEmpty():
        walked = walk.run(again, starts, ends_schema, grid=False)
        if ends is not None:
            redone = again.select(same(*walk.pieces).alias("_p")).distinct()
            walked = walked.unionByName(ends.withColumn("_p", same(*walk.pieces)).join(redone, "_p", "left_anti").drop("_p"))
        ends = written(walked)
        spans = ends.select(same(*walk.band).alias("_b"), *walk.pieces, F.explode("_cover").alias("_s")).join(cut, "_b")
        last = F.least(F.floor(F.col("_s.until") / F.lit(chunk)).cast("bigint"), F.col("_hi"))
        spans = spans.withColumn("_to", last).filter("_to > _piece").withColumn("_to", F.explode(F.sequence(F.col("_piece") + 1, "_to")))
        spans = spans.groupBy(*walk.band, F.col("_to").alias("_piece"), "_s.col").agg(F.max_by("_s", spans["_piece"]).alias("_s"))
        handed = written(spans.groupBy(*walk.pieces).agg(F.sort_array(F.collect_list("_s")).alias("_cover")))
        # A piece is walked again where its start has come, gone or changed.
        old, new = (df.select(same(*walk.pieces).alias("_p"), F.col("_cover").alias(n)) for df, n in ((starts, "_old"), (handed, "_new")))
        changed = old.join(new, "_p", "full_outer").filter(~F.col("_old").eqNullSafe(F.col("_new"))).select("_p")
        again = written(cells.withColumn("_p", same(*walk.pieces)).join(changed, "_p", "left_semi").drop("_p"))
        starts = handed
    return starts


def cell_css(cells: DataFrame, style: str = "style") -> DataFrame:
    return cells.withColumn("css", css_map(style, "last_lower"))


def caption_to_paragraph(tables: DataFrame) -> DataFrame:
    """Block rows of tables with a caption in front of each captioned one; input has ``caption`` and ``pos``."""
    has = F.length(F.coalesce("caption", F.lit(""))) > 0
    para = F.struct(F.lit(0).alias("sub_pos"), F.lit("para").alias("kind"), F.col("caption").alias("text"))
    tbl = F.struct(F.lit(1).alias("sub_pos"), F.lit("table").alias("kind"), F.lit(None).cast("string").alias("text"))
    rows = tables.select("doc_id", "pos", F.explode(F.when(has, F.array(para, tbl)).otherwise(F.array(tbl))).alias("b"))
    return rows.select("doc_id", "pos", "b.*")


def fit_images(images: DataFrame, tables: DataFrame, content_emu: Column) -> DataFrame:
    """Images inside tables shrunk, ratio kept, to their share of the text width.

    The share is the width over the columns of all tables around the image.  ``images``
    has ``(doc_id, pos, cx, cy)``, ``tables`` ``(doc_id, pos, close_pos, n_cols)``.
    """
    from inkshard.operators.nodes import contained_in

    around = contained_in(images, tables.select("doc_id", "pos", "close_pos", "n_cols"), ["n_cols"])
    widths = around.groupBy("doc_id", "pos").agg(F.sum("n_cols").alias("nested_cols"), F.first("cx").alias("cx"), F.first("cy").alias("cy"))
    limit = content_emu / F.col("nested_cols")
    wide = F.col("cx") > limit
    return widths.withColumns(
        {"new_cx": F.when(wide, F.floor(limit)).otherwise(F.col("cx")).cast("bigint"), "new_cy": F.when(wide, F.floor(F.col("cy") * (limit / F.col("cx")))).otherwise(F.col("cy")).cast("bigint")}
    )
