"""Node trees ``(doc_id, pos, close_pos, depth, tag, attrs, text)``: containment, parents, rewrites."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from inkshard.functions.css import css_cascade, paragraph_format
from inkshard.functions.media import sized_image, svg_data_uri
from inkshard.operators.ordered import CHUNK, over_groups
from inkshard.session import saved, written
from inkshard.sources.html import html_chains, html_drawings

# Events of a structural merge at one position: intervals end, rows ask, intervals begin.
_CLOSE, _ASK, _OPEN = 0, 1, 2


def _merged(inner: DataFrame, outer: DataFrame, span: Column, tie: Column, chunk: int) -> DataFrame:
    """Both sides as one stream of events with ``_level``, the number of intervals open at each.

    Positions are cut into chunks.  A chunk starts from the stack of intervals that earlier ones left open:
    they begin in it once more, in front of everything.  So each chunk is a merge of its own, and what
    is listed again is one stack for each ``chunk`` positions, up to the last inner row of a document.
    """
    last = inner.groupBy("doc_id").agg(F.max("pos").alias("_last"))
    held = outer.filter("close_pos > pos").join(last, "doc_id").filter("_last > pos")
    place = lambda c: F.floor(F.col(c) / F.lit(chunk)).cast("bigint")
    null = F.lit(None).cast("bigint")

    def event(at: Column, kind: int, step: int, wide: Column, tied: Column) -> Column:
        return F.struct(at.cast("bigint").alias("_at"), F.lit(kind).alias("_event"), wide.cast("bigint").alias("_wide"), tied.alias("_tie"), F.lit(step).alias("_step"))

    spans = held.select("doc_id", "pos", "close_pos", span.alias("_span"), tie.alias("_t"), F.explode(F.sequence(place("pos"), F.least(place("close_pos"), place("_last")))).alias("_chunk"))
    begins = event(F.col("pos"), _OPEN, 1, -F.col("close_pos"), F.col("_t"))
    ends = F.when(F.col("_chunk") == place("close_pos"), event(F.col("close_pos"), _CLOSE, -1, null, null))
    spans = spans.select("doc_id", "_chunk", "_span", F.explode(F.array_compact(F.array(begins, ends))).alias("_e")).select("doc_id", "_chunk", "_e.*", "_span")
    asks = inner.select("doc_id", F.coalesce(place("pos"), F.lit(0)).alias("_chunk"), event(F.col("pos"), _ASK, 0, null, null).alias("_e"), F.struct(*inner.columns).alias("_row"))
    events = spans.unionByName(asks.select("doc_id", "_chunk", "_e.*", "_row"), allowMissingColumns=True)
    return events.withColumn("_level", F.sum("_step").over(_so_far("doc_id", "_chunk")))


def _so_far(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("_at", "_event", "_wide", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def contained_in(inner: DataFrame, outer: DataFrame, outer_columns: Sequence[str] = (), chunk: int = CHUNK) -> DataFrame:
    """Pairs of an inner row and every outer interval around it: a structural merge along the positions of a document.

    Beginnings and ends of intervals and inner rows pass in order.  The stack of open intervals has one place
    for each level: the interval last begun on it.  A running sum tells how high the stack is, and an inner row takes what
    lies on each level up to that.  So work is that of the input and of the pairs.

    Outer intervals lie inside or beside each other, as those of a tree do; repeated ones count each.  Intervals
    that cross have no stack, and an inner row for which that matters fails the query.  Empty intervals, null documents
    and null positions are in no pair; an empty side gives no rows.
    """
    span = F.struct(F.col("pos").alias("outer_pos"), F.col("close_pos").alias("outer_close"), *[F.col(c).alias(f"outer_{c}" if c in inner.columns else c) for c in outer_columns])
    # Equal intervals differ, if at all, in what they carry; their order must be the same whenever a lost task runs again.
    tie = F.xxhash64(F.to_json(F.struct(*outer_columns))) if outer_columns else F.lit(None).cast("bigint")
    events = _merged(inner.filter("doc_id IS NOT NULL AND pos IS NOT NULL"), outer, span, tie, chunk)
    places = F.when(F.col("_event") == _OPEN, F.array("_level")).when((F.col("_event") == _ASK) & (F.col("_level") > 0), F.sequence(F.lit(1).cast("bigint"), "_level"))
    placed = events.withColumn("_level", F.explode(places))
    pairs = placed.withColumn("_around", F.last("_span", ignorenulls=True).over(_so_far("doc_id", "_chunk", "_level"))).filter(F.col("_event") == _ASK)
    # As many intervals as are open, all different: if each is around the row, they are those that are.
    around = (F.col("_around.outer_pos") < F.col("_at")) & (F.col("_around.outer_close") > F.col("_at"))
    pairs = pairs.filter(F.when(around, True).otherwise(F.raise_error(F.lit("outer intervals cross")).cast("boolean")))
    return pairs.select("_row.*", "_around.*")


def inside_any(inner: DataFrame, outer: DataFrame, negate: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Inner rows that lie (or, with ``negate``, do not lie) inside some outer interval: those with an open one at their position.

    Intervals may cross.  A row without document or position lies in none.
    """
    events = _merged(inner, outer, F.lit(True), F.lit(None).cast("bigint"), chunk)
    inside = F.col("_at").isNotNull() & (F.col("_level") > 0)
    return events.filter((F.col("_event") == _ASK) & (~inside if negate else inside)).select("_row.*")


def parent_of(nodes: DataFrame, **limits) -> DataFrame:
    """Add ``parent_tag`` and ``parent_at`` where only order and depth are known: the last node one level up."""
    def side(role: str, depth: Column, value: Column) -> DataFrame:
        return nodes.select("doc_id", "pos", depth.alias("_level"), F.lit(role).alias("_role"), value.alias("_node"))

    node = F.struct(F.col("pos").alias("pos"), F.col("tag").alias("tag"))
    events = side("open", F.col("depth") + 1, node).unionByName(side("ask", F.col("depth"), F.lit(None)))
    found = over_groups(events, ["doc_id", "_level"], ["pos"], lambda df, scan: scan.running(df, _parent=("last", F.col("_node"))), **limits)
    found = found.filter(F.col("_role") == "ask").select("doc_id", "pos", F.col("_parent.tag").alias("parent_tag"), F.col("_parent.pos").alias("parent_at"))
    return nodes.join(found, ["doc_id", "pos"])


def _lists(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("tag").isin("ol", "ul")).select("doc_id", "pos", "close_pos", "depth", "parent_pos", "tag")


def _inside_lists(lists: DataFrame) -> DataFrame:
    parents = lists.select("doc_id", F.col("pos").alias("parent_pos"), F.col("tag").alias("parent_tag"))
    return lists.join(parents, ["doc_id", "parent_pos"]).select("doc_id", "pos", "close_pos", "depth", "parent_pos", "parent_tag", "tag")


def orphan_lists(nodes: DataFrame) -> DataFrame:
    """Lists that stand directly inside a list; each is to be wrapped in a marker-less item.

    Lists are written once, as they meet themselves: what makes the nodes runs once.
    """
    return _inside_lists(written(_lists(nodes)))


def wrap_orphan_lists(nodes: DataFrame) -> DataFrame:
    """Nodes plus a synthetic item in front of every orphan list; ``sub_pos`` -1 places it before its list.

    Nodes are written once; what makes them runs once.
    """
    nodes = written(nodes)
    items = _inside_lists(_lists(nodes)).select("doc_id", "pos", "close_pos", "depth", "parent_pos", F.lit("li").alias("tag"), F.lit(-1).alias("sub_pos"), F.lit(True).alias("marker_suppressed"))
    return nodes.withColumns({"sub_pos": F.lit(0), "marker_suppressed": F.lit(False)}).unionByName(items, allowMissingColumns=True)


def formatted_paragraphs(nodes: DataFrame) -> DataFrame:
    """Paragraphs with a usable indent or alignment, as ``twips`` and ``align``."""
    p = nodes.filter((F.col("tag") == "p") & (F.length(F.col("attrs")["style"]) > 0)).withColumn("_f", paragraph_format(F.col("attrs")["style"]))
    p = p.withColumns({"twips": F.col("_f.twips"), "align": F.col("_f.align")}).drop("_f")
    return p.filter(F.col("twips").isNotNull() | F.col("align").isNotNull())


def sizeable_images(nodes: DataFrame) -> DataFrame:
    """Images that state no size and carry a readable raster, with the pixel size to give them."""
    a = F.col("attrs")
    sized = nodes.filter(F.col("tag") == "img").withColumn("_s", sized_image(a["src"], a["style"], a["width"], a["height"]))
    return sized.filter(F.col("_s").isNotNull()).withColumns({"width_px": F.col("_s.width"), "height_px": F.col("_s.height")}).drop("_s")


def is_caption(blocks: DataFrame, spans: DataFrame, caption_class: str = "rte-caption") -> DataFrame:
    """Blocks holding, at any depth, a span of the caption class; blocks are the intervals."""
    marks = spans.filter((F.col("tag") == "span") & F.array_contains(F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+"), caption_class))
    hits = contained_in(marks.select("doc_id", "pos"), blocks.select("doc_id", "pos", "close_pos"))
    return blocks.join(hits.select("doc_id", F.col("outer_pos").alias("pos")).distinct(), ["doc_id", "pos"], "left_semi")


#: Formatting elements and what they are to the cascade.
RUN_KINDS = {"span": "Span", "b": "Strong", "strong": "Strong", "i": "Emph", "em": "Emph", "u": "Underline", "s": "Strikeout", "del": "Strikeout", "sup": "Superscript", "sub": "Subscript"}


def styled_runs(documents: DataFrame, html: str = "html") -> DataFrame:
    """``(doc_id, pos, tag, text, props)``: the text of each element and what it inherits from the formatting around it.

    The parser knows which elements are open, so one pass over a document gives the chains; no join.
    """
    runs = html_chains(documents, RUN_KINDS, html)
    return runs.select("doc_id", "pos", "tag", "text", css_cascade(F.col("chain")).alias("props"))


def top_level_svgs(documents: DataFrame, html: str = "html") -> DataFrame:
    """Drawings not inside another drawing, as data URIs of their markup, with the size they state."""
    found = html_drawings(documents, html)
    return found.select("doc_id", "pos", svg_data_uri("outer_html").alias("src"), F.col("attrs")["width"].alias("width"), F.col("attrs")["height"].alias("height"))


def markup_passthrough(docs: DataFrame, rewritten: DataFrame) -> DataFrame:
    """Documents with ``changed``: whether any node of theirs was rewritten."""
    hit = rewritten.select("doc_id").distinct().withColumn("_hit", F.lit(True))
    return docs.select("doc_id").join(hit, "doc_id", "left").select("doc_id", F.coalesce("_hit", F.lit(False)).alias("changed"))


def rewrite(nodes: DataFrame, *passes: tuple[Column, dict[str, Column] | Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """User rewrites, in order: ``(which rows, {column: value})``, or any table function as the second part.

    Before a table function nodes are saved, as both sides of it read them.
    """
    for which, change in passes:
        if callable(change):
            nodes = saved(nodes)  # its columns stay those that the conditions name
            nodes = nodes.filter(~which).unionByName(nodes.filter(which).transform(change))
        else:
            nodes = nodes.withColumns({c: F.when(which, v).otherwise(F.col(c)) for c, v in change.items()})
    return nodes


def _level_by_level(nodes: DataFrame, deepest_first: bool, near: Callable[[DataFrame], DataFrame], change: Mapping[str, Column]) -> DataFrame:
    """Nodes with ``change`` made on each level in turn; ``near`` turns the level before into what a node may look at, by doc_id and ``_pos``."""
    low, high = nodes.agg(F.min("depth"), F.max("depth")).first()
    low, high = (0, 0) if low is None else (low, high)
    own, done = written(nodes), []
    for depth in range(high, low - 1, -1) if deepest_first else range(low, high + 1):
        level = own.filter(F.col("depth") == depth)
        beside = near(done[-1] if done else own.withColumns({c: F.lit(None) for c in change if c not in own.columns}).filter("false"))
        at = level["pos"] if deepest_first else level["parent_pos"]
        seen = level.join(beside, (level["doc_id"] == beside["_doc"]) & (at == beside["_pos"]), "left").drop("_doc", "_pos")
        done.append(written(seen.withColumns(dict(change)).select(*own.columns, *[c for c in change if c not in own.columns])))
    return reduce(DataFrame.unionByName, done)


def rewrite_up(nodes: DataFrame, gather: Mapping[str, Column], change: Mapping[str, Column]) -> DataFrame:
    """Rewrite nodes bottom-up: a node's new values may use those of its children, which are made first.

    ``gather`` names aggregates over the children's rows as already rewritten (null for a node without
    children, but for counts); ``change`` names new values, of the node's own columns and the gathered ones.
    All nodes of one depth are one step, whatever their documents, so the steps are as many as the deepest
    node has ancestors; each is written before the next reads it.  Children meet by (doc_id, parent_pos) and combine map-side.
    """
    def near(level: DataFrame) -> DataFrame:
        return level.groupBy(F.col("doc_id").alias("_doc"), F.col("parent_pos").alias("_pos")).agg(*[e.alias(n) for n, e in gather.items()])

    return _level_by_level(nodes, True, near, change)


def rewrite_down(nodes: DataFrame, take: Mapping[str, Column], change: Mapping[str, Column]) -> DataFrame:
    """Rewrite nodes top-down: a node's new values may use ``take``, columns of its parent as already rewritten (null at the top)."""
    def near(level: DataFrame) -> DataFrame:
        return level.select(F.col("doc_id").alias("_doc"), F.col("pos").alias("_pos"), *[e.alias(n) for n, e in take.items()])

    return _level_by_level(nodes, False, near, change)
