"""Ordered scans over groups (documents, tables, workers), in one form for every size.

Most operators here carry state along the rows of a group: a running count, the last value
seen, the neighbour.  A plain window would put a whole group in one task.  ``over_groups``
cuts every group into chunks along its order instead: chunk number is the first order column
divided by a fixed size, so it needs no look at the data.  Rows are shuffled once, by group
and chunk; windows run inside a chunk, and one small summary for each scan, a row for each
chunk, carries state from chunk to chunk.  A document of ordinary size is one chunk, for
which nothing is carried or summed up; a huge one spreads over as many tasks as it has chunks.

``over_ranges`` is the form for logs and other orders without gapless positions: rows are range-sorted by
group and order, and a chunk is what one range holds of a group.  A burst is cut wherever it
lies, even inside one microsecond, as ranges hold about equal numbers of rows.

The plan is the same whatever the size of the input or of its groups.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkshard.session import written

#: Positions in a chunk.
CHUNK = 65_536

#: Buckets by which groups of several chunks are told from others.
BUCKETS = 65_536

_CHUNK = "_chunk"
Specs = Mapping[str, tuple[str, Column]]


class Scan:
    """Window computations along ``order`` within ``keys``, over rows that carry their chunk."""

    def __init__(self, keys: Sequence[str], order: Sequence[str], usual: int | None = None):
        self.keys = list(keys)
        self.order = list(order)
        #: The chunk in which ordinary groups lie whole, if there is one.
        self.usual = usual

    @property
    def pieces(self) -> list[str]:
        """Columns that cut the rows into pieces small enough for one task."""
        return [*self.keys, _CHUNK]

    def by(self, *keys: str) -> Scan:
        """The same scan over a finer grouping (``keys`` must contain the present ones)."""
        return type(self)(keys, self.order, self.usual)

    def _inside(self, last_row: int = Window.currentRow, backwards: bool = False):
        order = [F.desc(o) for o in self.order] if backwards else self.order
        return Window.partitionBy(*self.pieces).orderBy(*order).rowsBetween(Window.unboundedPreceding, last_row)

    def _along(self, backwards: bool = False):
        """Over the chunks of a group, one row each."""
        return Window.partitionBy(*self.keys).orderBy(F.desc(_CHUNK) if backwards else F.asc(_CHUNK))

    def _cut(self, df: DataFrame) -> DataFrame:
        """Rows of the groups that lie in several chunks, and of some others: all a summary needs.

        Groups with a row outside the usual chunk are known by the bucket of their hash alone, so what every task
        is told has a bound whatever the groups.  Where there are none, the rows are not read for a summary.
        """
        if self.usual is None:
            return df
        bucket = F.pmod(F.hash(*self.keys), F.lit(BUCKETS))
        cut = df.filter(F.col(_CHUNK) != self.usual).select(bucket.alias("_bucket")).distinct()
        return df.withColumn("_bucket", bucket).join(F.broadcast(cut), "_bucket", "left_semi").drop("_bucket")

    def _carried(self, df: DataFrame, summaries: Mapping[str, Column], carry: Mapping[str, Column]) -> DataFrame:
        """``df`` with what its chunk starts from: ``carry`` over the chunk summaries, null where there is nothing to carry."""
        start = self._cut(df).groupBy(*self.pieces).agg(*[e.alias(n) for n, e in summaries.items()]).select(*self.pieces, *[e.alias(n) for n, e in carry.items()])
        return df.join(start.dropna("all", subset=list(carry)), self.pieces, "left")

    def together(self, df: DataFrame, running: Specs = {}, preceding: Specs = {}, following: Specs = {}, totals: Specs = {}) -> DataFrame:
        """Add values of several kinds behind one summary: ``name=(kind, expr)``, kind one of sum, min, max, xor, last, first (non-null).

        ``running`` takes the rows up to the present one, ``preceding`` those before it, ``following``
        those after it from the end of the group on (so ``last`` is the nearest), ``totals`` all.
        """
        sums, carry, columns, wholes = {}, {}, {}, {}
        earlier = (Window.unboundedPreceding, -1)
        whole = (Window.unboundedPreceding, Window.unboundedFollowing)
        for specs, backwards, last_row in ((running, False, Window.currentRow), (preceding, False, -1), (following, True, -1)):
            for n, (kind, e) in specs.items():
                sums[f"_c_{n}"] = self._summary(kind, e, backwards)
                carry[f"_c_{n}"] = _window_agg(kind, F.col(f"_c_{n}")).over(self._along(backwards).rowsBetween(*earlier))
                columns[n] = _merge(kind, F.col(f"_c_{n}"), _window_agg(kind, e).over(self._inside(last_row, backwards)))
        several = F.count(F.lit(1)).over(Window.partitionBy(*self.keys)) > 1
        for n, (kind, e) in totals.items():
            sums[f"_c_{n}"] = self._summary(kind, e)
            # Of a group in one chunk the window knows the total, and nothing is carried.
            carry[f"_c_{n}"] = F.when(several, _window_agg(kind, F.col(f"_c_{n}")).over(self._along().rowsBetween(*whole)))
            ordered = kind in ("last", "first")
            wholes[n] = F.coalesce(F.col(f"_c_{n}"), _window_agg(kind, e).over(self._inside(Window.unboundedFollowing) if ordered else Window.partitionBy(*self.pieces)))
        # Totals last: rows stay sorted for them, whichever way the other windows went.
        return self._carried(df, sums, carry).withColumns(columns).withColumns(wholes).drop(*carry)

    def running(self, df: DataFrame, include_current: bool = True, backwards: bool = False, **specs: tuple[str, Column]) -> DataFrame:
        """Add running values; ``backwards`` runs from the end of the group and leaves the present row out."""
        if backwards:
            return self.together(df, following=specs)
        return self.together(df, running=specs) if include_current else self.together(df, preceding=specs)

    def totals(self, df: DataFrame, **specs: tuple[str, Column]) -> DataFrame:
        """Add whole-group values."""
        return self.together(df, totals=specs)

    def _summary(self, kind: str, expr: Column, backwards: bool = False) -> Column:
        if kind in ("last", "first"):
            at = F.when(expr.isNotNull(), F.struct(*self.order))
            return F.max_by(expr, at) if (kind == "last") != backwards else F.min_by(expr, at)
        return _COMBINE[kind](expr)

    def neighbours(self, df: DataFrame, lag: Mapping[str, Column] = {}, lead: Mapping[str, Column] = {}) -> DataFrame:
        """Add values of the previous (``lag``) and next (``lead``) row."""
        at = F.struct(*self.order)
        edges = {f"_c_{n}": F.max_by(F.struct(e.alias("v")), at) for n, e in lag.items()} | {f"_c_{n}": F.min_by(F.struct(e.alias("v")), at) for n, e in lead.items()}
        beside = {f"_c_{n}": F.lag(f"_c_{n}").over(self._along()) for n in lag} | {f"_c_{n}": F.lead(f"_c_{n}").over(self._along()) for n in lead}
        df = self._carried(df, edges, beside)
        w = Window.partitionBy(*self.pieces).orderBy(*self.order)
        # A struct tells "no row there" from a row whose value is null.
        value = lambda e: F.struct(e.alias("v"))
        cols = {n: F.coalesce(F.lag(value(e)).over(w), F.col(f"_c_{n}"))["v"] for n, e in lag.items()}
        cols |= {n: F.coalesce(F.lead(value(e)).over(w), F.col(f"_c_{n}"))["v"] for n, e in lead.items()}
        return df.withColumns(cols).drop(*[f"_c_{n}" for n in (*lag, *lead)])

    def joined_text(self, df: DataFrame, text: str, sep: str = "") -> DataFrame:
        """``(keys, part, text, n)``: texts of a group joined in order, a part for each chunk.

        Parts bear the chunk's number and follow each other with ``sep`` between.
        """
        packed = df.groupBy(*self.pieces).agg(F.array_sort(F.collect_list(F.struct(*self.order, F.col(text).alias("_t")))).alias("_r"))
        joined = F.array_join(F.transform("_r", lambda r: r["_t"]), sep)
        return packed.select(*self.keys, F.col(_CHUNK).alias("part"), joined.alias("text"), F.size("_r").cast("bigint").alias("n"))

    def ordinal(self, df: DataFrame, name: str, when: Column | None = None) -> DataFrame:
        """Running number of the rows (of those where ``when`` holds)."""
        one = F.lit(1).cast("bigint") if when is None else F.when(when, F.lit(1).cast("bigint")).otherwise(0)
        return self.running(df, **{name: ("sum", one)})

    def count_since(self, df: DataFrame, **specs: tuple[Column, Column]) -> DataFrame:
        """``name=(counted, reset)``: rows where ``counted`` holds after the last ``reset`` row, this row included."""
        w, earlier = self._inside(), self._along().rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumns({f"_n_{n}": F.sum(F.when(c, 1).otherwise(0)).over(w) for n, (c, _) in specs.items()})
        df = df.withColumns({f"_m_{n}": F.max(F.when(r, F.col(f"_n_{n}"))).over(w) for n, (_, r) in specs.items()})
        marks = self._cut(df).groupBy(*self.pieces).agg(*[e for n in specs for e in (F.max(f"_n_{n}").alias(f"_a_{n}"), F.max(f"_m_{n}").alias(f"_z_{n}"))])
        # Counted in earlier chunks, and of that what came before the last reset; counts never fall, so the last is the largest.
        marks = marks.withColumns({f"_t_{n}": F.sum(f"_a_{n}").over(earlier) for n in specs})
        marks = marks.withColumns({f"_r_{n}": F.max(F.coalesce(F.col(f"_t_{n}"), F.lit(0)) + F.col(f"_z_{n}")).over(earlier) for n in specs})
        start = marks.select(*self.pieces, *[(F.col(f"_t_{n}") - F.coalesce(F.col(f"_r_{n}"), F.lit(0))).alias(f"_c_{n}") for n in specs])
        df = df.join(start.dropna("all", subset=[f"_c_{n}" for n in specs]), self.pieces, "left")
        out = {n: F.when(F.col(f"_m_{n}").isNull(), F.col(f"_n_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).otherwise(F.col(f"_n_{n}") - F.col(f"_m_{n}")) for n in specs}
        return df.withColumns(out).drop(*[f"{p}{n}" for p in ("_n_", "_m_", "_c_") for n in specs])

    def floored_level(self, df: DataFrame, name: str, delta: Column) -> DataFrame:
        """Running sum of ``delta`` that never goes below zero (a stack depth, a gauge)."""
        w, earlier = self._inside(), self._along().rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn("_s", F.sum(delta).over(w)).withColumn("_low", F.min("_s").over(w))
        chunks = self._cut(df).groupBy(*self.pieces).agg(F.sum(delta).alias("_sum"), F.min("_s").alias("_least"))
        chunks = chunks.withColumn("_before", F.sum("_sum").over(earlier))
        chunks = chunks.withColumn("_lowest", F.min(F.coalesce("_before", F.lit(0)) + F.col("_least")).over(earlier))
        df = df.join(chunks.select(*self.pieces, "_before", "_lowest").dropna(subset=["_before"]), self.pieces, "left")
        before = F.coalesce("_before", F.lit(0))
        return df.withColumn(name, before + F.col("_s") - F.least(F.lit(0), F.col("_lowest"), before + F.col("_low"))).drop("_s", "_low", "_before", "_lowest")


_COMBINE = {"sum": F.sum, "min": F.min, "max": F.max, "xor": F.bit_xor}


def _window_agg(kind: str, expr: Column) -> Column:
    if kind == "last":
        return F.last(expr, ignorenulls=True)
    if kind == "first":
        return F.first(expr, ignorenulls=True)
    return _COMBINE[kind](expr)


def _merge(kind: str, before: Column, within: Column) -> Column:
    if kind == "sum":
        return F.coalesce(before + within, before, within)
    if kind == "xor":
        return F.coalesce(before.bitwiseXOR(within), before, within)
    if kind == "last":
        return F.coalesce(within, before)
    if kind == "first":
        return F.coalesce(before, within)
    return {"min": F.least, "max": F.greatest}[kind](before, within)


def over_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], body: Callable[[DataFrame, Scan], DataFrame], chunk: int = CHUNK) -> DataFrame:
    """Apply ``body(df, scan)`` to every group.

    ``order`` columns must tell the rows of a group apart; the first is a number and cuts the group
    into chunks of ``chunk`` units.  ``body`` may only combine rows through ``scan``, row-wise
    expressions and filters.
    """
    number = F.coalesce(F.floor(F.col(order[0]) / F.lit(chunk)).cast("bigint"), F.lit(-1).cast("bigint") - (1 << 40))
    return body(df.withColumn(_CHUNK, number), Scan(keys, order, usual=0)).drop(_CHUNK)


def over_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], body: Callable[[DataFrame, Scan], DataFrame], ranges: int | None = None) -> DataFrame:
    """Apply ``body(df, scan)`` to every group, cut into ranges of about equal numbers of rows.

    ``order`` columns must tell the rows of a group apart, or rows that they do not must be
    equal for ``body``; nulls come first.  ``df`` should have no more columns than ``body`` needs: its rows are saved once
    in the shared folder, because ranges are found by a sample and must not move between the
    two uses of a chunk, nor when a lost executor's rows are read again.
    ``ranges`` is the number of ranges, by default that of shuffle partitions.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A struct of keys equals another where both have nulls, which plain keys of a join do not.
    dealt = df.withColumn("_group", F.struct(F.lit(0), *keys)).repartitionByRange(n, "_group", *order)
    return body(written(dealt.withColumn(_CHUNK, F.spark_partition_id().cast("bigint"))), Scan(["_group"], order)).drop(_CHUNK, "_group")
