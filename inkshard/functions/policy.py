"""Route, option, size and content-safety rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkshard.functions import constants as K
from inkshard.functions.text import col, first, lookup, one_of


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def route_error(source: Column | str, target: Column | str) -> Column:
    """Why a route is refused, null when it is allowed; checks run in a fixed order."""
    s, t = col(source), col(target)
    name = r"^[\p{L}\p{N}]+$"
    return (
        F.when(~(s.rlike(name) & t.rlike(name)), "Format parameters must be alphanumeric")
        .when(~one_of(s, K.SOURCE_FORMATS), F.concat(F.lit("Invalid source format: "), s))
        .when(~one_of(t, K.TARGET_FORMATS), F.concat(F.lit("Invalid target format: "), t))
    )


def allowed_options(filter_dir: str) -> list[str]:
    """Every option a conversion may carry when its rewrite steps live in ``filter_dir``."""
    return [*(f"--lua-filter={filter_dir}/{name}.lua" for name in K.REWRITES), *K.PLAIN_OPTIONS, *K.PREFIX_OPTIONS]


def bad_option(options: Column | str, allowed=None, prefixes=None) -> Column:
    """First option that is neither allowed as it is nor starts with an allowed prefix; null when all are fine."""
    exact = _words(allowed if allowed is not None else [*K.PLAIN_OPTIONS, *K.PREFIX_OPTIONS])
    starts = _words(prefixes if prefixes is not None else K.PREFIX_OPTIONS)
    return first(F.filter(col(options), lambda o: ~(F.array_contains(exact, o) | F.exists(starts, lambda p: o.startswith(p)))))


def size_limit_bytes(limit_mb) -> int:
    """Limit in bytes; anything but a positive whole number means the default."""
    try:
        value = int(limit_mb)
    except (TypeError, ValueError):
        value = 0
    return (value if value > 0 else K.DEFAULT_LIMIT_MB) * 1024 * 1024


def within_size(body: Column | str, limit_mb=K.DEFAULT_LIMIT_MB) -> Column:
    return F.octet_length(col(body)) <= F.lit(size_limit_bytes(limit_mb))


def drops_raw(raw_format: Column | str, target: Column | str) -> Column:
    """Raw TeX is dropped where the target is typeset by TeX."""
    return one_of(F.lower(col(raw_format)), K.RAW_TEX_FORMATS) & one_of(col(target), K.LATEX_TARGETS)


def unsafe_math(tex: Column | str) -> Column:
    """A formula that names a denied control word, or reaches for ``@`` or ``^^``."""
    t = col(tex)
    names = F.regexp_extract_all(t, F.lit(r"\\([A-Za-z]+)"), F.lit(1))
    return F.arrays_overlap(names, _words(K.DENIED_TEX)) | t.contains("@") | t.contains("^^")


def has_svg(html: Column | str) -> Column:
    low = F.lower(col(html))
    return low.contains("data:image/svg+xml") | low.contains("<svg")


def has_color_macro(html: Column | str) -> Column:
    return col(html).contains("\\color") | col(html).contains("\\textcolor")


def heading_level(kind: Column | str, level: Column | str, classes: Column | str) -> Column:
    """Level of a block: headings are capped at 9; a div of class ``heading-N``, N over 6, is a heading."""
    deep = first(F.filter(F.transform(col(classes), lambda c: F.regexp_extract(c, r"^heading-(\d+)$", 1).try_cast("int")), lambda n: n > 6))
    # least() skips nulls, so the cap must not turn a missing level into 9.
    cap = lambda n: F.when(n > K.MAX_HEADING, K.MAX_HEADING).otherwise(n)
    return F.when(col(kind) == "header", cap(col(level).cast("int"))).when(col(kind) == "div", cap(deep))


def page_command(text: Column | str, is_raw: Column) -> Column:
    """Page break or turn a paragraph asks for; raw nodes must be exactly the command."""
    t = col(text)
    hit = lambda cmd: F.when(is_raw, t == F.lit(cmd)).otherwise(t.contains(cmd))

    def page(kind: str, w, h, orient) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(w).cast("int").alias("w"), F.lit(h).cast("int").alias("h"), F.lit(orient).cast("string").alias("orient"))

    return (
        F.when(hit("\\pageLandscape"), page("section", 16838, 11906, "landscape"))
        .when(hit("\\pagePortrait"), page("section", 11906, 16838, "portrait"))
        .when(hit("\\newpage"), page("page", None, None, None))
    )


def placeholder_kind(text: Column | str, style: Column | str) -> Column:
    """toc, tof or tot for a body paragraph that is exactly a placeholder."""
    body = col(style).isNull() | one_of(col(style), K.PLACEHOLDER_STYLES)
    return F.when(body, lookup(F.regexp_replace(col(text), r"^\s+|\s+$", ""), K.PLACEHOLDERS))


def caption_kind(style: Column | str, next_kind: Column | str, seq: Column | str) -> Column:
    """figure or table: own style first, then a following table, then the sequence name."""
    s, q = col(style), col(seq)
    return (
        F.when(s == "ImageCaption", "figure")
        .when((s == "TableCaption") | (F.coalesce(col(next_kind), F.lit("")) == "table"), "table")
        .when(q.isNull() | (q == "Figure"), "figure")
        .otherwise("table")
    )


def protected_path(path: Column | str) -> Column:
    p = col(path)
    return one_of(F.regexp_replace(p, "/+$", ""), K.PROTECTED_PATHS) | p.startswith(K.PROTECTED_PREFIX)


def bearer_token(authorization: Column | str) -> Column:
    a = col(authorization)
    token = F.trim(F.substr(a, F.instr(a, " ") + 1))
    return F.when((F.lower(F.substring_index(a, " ", 1)) == "bearer") & a.contains(" "), F.nullif(token, F.lit("")))


def route_steps(source: Column | str, target: Column | str, sandbox: Column, preserve: Column) -> Column:
    """Ordered rewrite steps a route triggers."""
    s, t = col(source), col(target)
    to_latex = one_of(t, K.LATEX_TARGETS)
    html_docx = (s == "html") & (t == "docx")
    docx_latex = (s == "docx") & to_latex
    step = lambda cond, name: F.when(cond, name)
    steps = [
        step(docx_latex, "docx_latex_rewrite"),
        step(html_docx, "list_rewrite"),
        step(html_docx, "paragraph_rewrite"),
        step(html_docx, "math_color_rewrite"),
        step(html_docx, "image_rewrite"),
        step(sandbox, "sandbox"),
        step(sandbox & to_latex, "strip_raw_tex"),
        step(sandbox & to_latex, "strip_document_images"),
        step(html_docx, "inline_styles"),
        step(html_docx, "html_lists"),
        step(html_docx, "html_captions"),
        step(html_docx & preserve, "preserve_table_styles"),
        step((s == "html") & to_latex, "html_tables_to_latex"),
        *[step(docx_latex, n) for n in ("docx_text_decorations", "docx_colors_to_latex", "docx_math_colors_to_latex", "docx_paragraphs_to_latex", "docx_lists_to_latex", "docx_tables_to_latex", "docx_caption_labels_to_latex")],
    ]
    return F.array_compact(F.array(*steps))
