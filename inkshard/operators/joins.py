"""Media, styles and placeholders matched against what a document carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkshard.functions import constants as K
from inkshard.functions.color import cell_hex, run_hex
from inkshard.functions.policy import drops_raw
from inkshard.functions.styles import half_points, style_id
from inkshard.operators.ordered import over_groups


def drop_raw_tex(blocks: DataFrame, target: Column | str, raw_format: str = "format") -> DataFrame:
    drops = drops_raw(raw_format, F.lit(target) if isinstance(target, str) else target)
    return blocks.filter(~F.coalesce(drops, F.lit(False)))


def drop_document_images(images: DataFrame, media: DataFrame, target: str = "pdf") -> DataFrame:
    """Images a typeset document may keep: carried in the page, or in the document's media."""
    if target not in K.LATEX_TARGETS:
        return images
    inline = F.col("src").startswith("data:")
    carried = images.filter(~inline).join(media.select("doc_id", "src").distinct(), ["doc_id", "src"], "left_semi")
    return images.filter(inline).unionByName(carried)


def media_inventory(images: DataFrame, media: DataFrame) -> DataFrame:
    """Referenced against carried media: used, unresolved references, orphans."""
    left = images.groupBy("doc_id", "src").agg(F.count(F.lit(1)).alias("uses"))
    right = media.select("doc_id", "src").distinct().withColumn("_m", F.lit(True))
    state = F.when(F.col("_m").isNull(), "unresolved").when(F.col("uses").isNull(), "orphan").otherwise("used")
    return left.join(right, ["doc_id", "src"], "full_outer").select("doc_id", "src", F.coalesce("uses", F.lit(0)).alias("uses"), state.alias("state"))


def with_style_id(runs: DataFrame, prefix: str | None = None) -> DataFrame:
    """Runs with normalised properties and the id of the style they need, null when they need none.

    Expects raw ``color``, ``fill``, ``highlight``, ``sz`` and ``sz_cs``.
    """
    fg, bg, sz, cs = run_hex("color"), run_hex("fill"), half_points("sz"), half_points("sz_cs")
    hl = F.nullif(F.col("highlight"), F.lit("none"))
    out = runs.withColumns({"fg": fg, "bg": bg, "hl": hl, "size": sz, "size_cs": cs})
    parts = [F.col(c) for c in ("fg", "bg", "hl", "size", "size_cs")]
    sid = style_id(*parts) if prefix is None else style_id(*parts, prefix=prefix)
    return out.withColumn("style_id", F.when(F.coalesce(*parts).isNotNull(), sid))


def style_registry(runs: DataFrame) -> DataFrame:
    """Distinct styles each document needs and how many runs use them."""
    styled = with_style_id(runs).filter(F.col("style_id").isNotNull())
    return styled.groupBy("doc_id", "style_id", "fg", "bg", "hl", "size", "size_cs").agg(F.count(F.lit(1)).alias("uses"))


def missing_styles(needed: DataFrame, existing: DataFrame) -> DataFrame:
    """Needed styles whose id the document does not have yet."""
    return needed.join(existing.select("doc_id", "style_id").distinct(), ["doc_id", "style_id"], "left_anti")


def augment_styles(existing: DataFrame, needed: DataFrame) -> DataFrame:
    """Existing styles plus the missing ones; ids stay unique and a second run adds nothing.

    Needed styles are made unique and held against the existing ones in one grouping, of keys and a mark where
    they have no other columns, so that a task neither sorts nor joins.
    """
    keys = ["doc_id", "style_id"]
    rest = [c for c in needed.columns if c not in keys]
    row = [F.struct(*rest).alias("_row")] if rest else []
    marks = needed.select(*keys, F.lit(False).alias("_old"), *row).unionByName(existing.select(*keys, F.lit(True).alias("_old")), allowMissingColumns=True)
    added = marks.groupBy(*keys).agg(F.bool_or("_old").alias("_old"), *[F.first("_row", ignorenulls=True).alias("_row") for _ in row]).filter(~F.col("_old"))
    return existing.unionByName(added.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]), allowMissingColumns=True)


_IMG, _HREF = r"\{\{IMG:(.*?)\}\}", r"\{\{HREF:(.*?)\}\}"


def resolve_placeholders(runs: DataFrame, **limits) -> DataFrame:
    """Runs with placeholders resolved: embedded images and numbered links.

    An image whose source is base64 data is kept as ``image``, any other becomes the text
    ``[image]``.  Links get ``rel_id``, numbered per document by first use; the tooltip
    goes.  Expects ``(doc_id, pos, text, tooltip)``.
    """
    src = F.regexp_extract("text", _IMG, 1)
    has_img = F.col("text").rlike(_IMG)
    data = F.try_to_binary(F.regexp_extract(src, r"^data:[^;]+;base64,(.*)$", 1), F.lit("base64"))
    ok = has_img & src.rlike(r"^data:[^;]+;base64,.") & data.isNotNull()
    runs = runs.withColumns(
        {
            "image": F.when(ok, src),
            "text": F.when(ok, F.lit(None)).when(has_img, F.regexp_replace("text", _IMG, "[image]")).otherwise(F.col("text")),
            "url": F.when(F.col("tooltip").rlike(_HREF), F.regexp_extract("tooltip", _HREF, 1)),
        }
    )
    runs = runs.withColumn("tooltip", F.when(F.col("url").isNull(), F.col("tooltip")))
    used = runs.filter("url is not null").groupBy("doc_id", "url").agg(F.min("pos").alias("first_pos"))
    ids = over_groups(used, ["doc_id"], ["first_pos"], lambda df, scan: scan.ordinal(df, "_n"), **limits)
    ids = ids.select("doc_id", "url", F.concat(F.lit("rId"), F.col("_n").cast("string")).alias("rel_id"))
    return runs.join(ids, ["doc_id", "url"], "left")


def part_changed(parts: DataFrame, changed: str = "changed") -> DataFrame:
    return parts.groupBy("doc_id").agg(F.bool_or(changed).alias("changed"))


def tagged_cells(cells: DataFrame, fill: str = "fill") -> DataFrame:
    """Cells with the background they carry as a mark, white and automatic ones aside."""
    return cells.withColumn("bg", cell_hex(fill)).filter(F.col("bg").isNotNull())


def markup_profile(tokens: DataFrame) -> DataFrame:
    """Element usage of each document, which tells the rewrites that would fire."""
    opened, tag = F.col("kind") == "open", F.col("tag")
    n = lambda t: F.count_if(opened & (tag == t)).alias(f"n_{t}")
    script = F.count_if((F.col("kind") == "script") & F.col("tok").contains("math/tex")).alias("n_math")
    p_open = (F.count_if(opened & (tag == "p")) - F.count_if((F.col("kind") == "close") & (tag == "p"))).alias("n_unclosed_p")
    return tokens.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), *[n(t) for t in ("p", "li", "table", "img", "svg")], script, p_open)


def tag_documents(tokens: DataFrame) -> DataFrame:
    """Uses of each tag and the documents it occurs in."""
    per_doc = tokens.filter("kind = 'open'").groupBy("tag", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("tag").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_uses"))

