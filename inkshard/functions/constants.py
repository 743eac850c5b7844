"""Formats, sizes, palettes, limits.  They must be exactly these for right results."""

from __future__ import annotations

# Formats a document can come in and go out as.
SOURCE_FORMATS = ["docx", "epub", "fb2", "html", "json", "latex", "markdown", "rtf", "textile"]
TARGET_FORMATS = ["docx", "epub", "fb2", "html", "json", "latex", "markdown", "odt", "pdf", "plain", "pptx", "rtf", "textile"]
TEXT_SOURCES = ["html", "markdown", "txt"]
LATEX_TARGETS = ["latex", "pdf"]

# MIME type by format name; anything else is an octet stream.
MIME_TYPES = {
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "epub": "application/epub+zip",
    "html": "text/html",
    "html5": "text/html",
    "json": "application/json",
    "latex": "application/x-latex",
    "markdown": "text/markdown",
    "md": "text/markdown",
    "odt": "application/vnd.oasis.opendocument.text",
    "pdf": "application/pdf",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "rtf": "application/rtf",
    "tex": "application/x-tex",
    "txt": "text/plain",
    "xml": "application/xml",
}
DEFAULT_MIME_TYPE = "application/octet-stream"

# File extension by format name; anything else is named docx.
FILE_EXTENSIONS = {
    "asciidoc": "adoc",
    "beamer": "pdf",
    "context": "tex",
    "docx": "docx",
    "dokuwiki": "txt",
    "epub": "epub",
    "html": "html",
    "html5": "html",
    "json": "json",
    "latex": "tex",
    "man": "man",
    "markdown": "md",
    "md": "md",
    "mediawiki": "wiki",
    "ms": "ms",
    "odt": "odt",
    "org": "org",
    "pdf": "pdf",
    "plain": "txt",
    "pptx": "pptx",
    "revealjs": "html",
    "rst": "rst",
    "rtf": "rtf",
    "tex": "tex",
    "textile": "textile",
    "txt": "txt",
    "xml": "xml",
}
DEFAULT_EXTENSION = "docx"

# Paper sizes in twips, width by height, portrait.
PAPER_TWIPS = {
    "A3": (16838, 23811),
    "A4": (11906, 16838),
    "A5": (8419, 11906),
    "B4": (14144, 20013),
    "B5": (9979, 14144),
    "JIS_B4": (14572, 20639),
    "JIS_B5": (10319, 14572),
    "LEDGER": (15840, 24480),
    "LEGAL": (12240, 20160),
    "LETTER": (12240, 15840),
}

# Slide sizes in inches, width by height.
SLIDE_INCHES = {
    "16:9": (10, 5.63),
    "4:3": (10, 7.5),
    "A3": (14, 10.5),
    "A4": (10.833, 7.5),
    "LEDGER": (13.333, 10),
    "LETTER": (10, 7.5),
    "WIDESCREEN": (13.33, 7.5),
}

# Twips per CSS unit.
TWIPS_PER_UNIT = {"px": 15.0, "pt": 20.0, "in": 1440.0, "cm": 1440 / 2.54, "mm": 1440 / 25.4, "pc": 240.0, "em": 240.0, "rem": 240.0}
# Pixels per CSS unit for image limits.
PX_PER_UNIT = {"": 1.0, "px": 1.0, "in": 96.0, "cm": 96 / 2.54, "mm": 96 / 25.4, "pt": 96 / 72, "pc": 16.0}
# Pixels per SVG unit; other units count as pixels.
SVG_PX_PER_UNIT = {"px": 1.0, "pt": 4 / 3, "in": 96.0, "cm": 96 / 2.54, "mm": 96 / 25.4, "pc": 16.0, "ex": 8.0}
# Half-points per font-size unit.
HALF_POINTS_PER_UNIT = {"": 2.0, "pt": 2.0, "px": 1.5, "pc": 24.0, "in": 144.0, "cm": 56.6929134, "mm": 5.66929134}
# Eighths of a point per border-width unit.
EIGHTHS_PER_UNIT = {"": 8.0, "pt": 8.0, "px": 6.0, "cm": 226.77, "mm": 22.677, "in": 576.0}
# Points per unit, for table widths as a share of the line.
POINTS_PER_UNIT = {"": 0.75, "px": 0.75, "pt": 1.0, "in": 72.0, "pc": 12.0, "cm": 28.3465, "mm": 2.83465}
LINE_POINTS = 468.0
LINE_TWIPS = 9360.0
FULL_WIDTH_PCT = 5000
EMU_PER_INCH = 914400
EMU_PER_TWIP = 635
LETTER_WIDTH_EMU = 7772400
SIDE_MARGIN_EMU = 914400
MAX_INDENT_TWIPS = 31680
DEFAULT_GRID_TWIPS = 4800

# Font-size words in half-points.
FONT_SIZE_WORDS = {"xx-small": 18, "x-small": 20, "small": 22, "medium": 24, "large": 28, "x-large": 36, "xx-large": 48}
DEFAULT_HALF_POINTS = 24
GENERIC_FONTS = ["serif", "sans-serif", "monospace", "cursive", "fantasy", "system-ui"]

# Text-align words and the justification each becomes.
TEXT_ALIGN = {"left": "left", "center": "center", "right": "right", "justify": "justify", "start": "left", "end": "right"}
ALIGN_TO_JC = {"left": "left", "center": "center", "right": "right", "justify": "both", "both": "both"}
JC_TO_ALIGN = {"left": "left", "center": "center", "right": "right", "start": "left", "end": "right"}

# Border styles.
BORDER_STYLES = {
    "solid": "single",
    "dashed": "dashed",
    "dotted": "dotted",
    "double": "double",
    "groove": "single",
    "ridge": "single",
    "inset": "single",
    "outset": "single",
    "none": "nil",
    "hidden": "nil",
}

# Highlighter palette.
HIGHLIGHT_HEX = {
    "black": "000000",
    "blue": "0000FF",
    "cyan": "00FFFF",
    "darkBlue": "000080",
    "darkCyan": "008080",
    "darkGray": "808080",
    "darkGreen": "008000",
    "darkMagenta": "800080",
    "darkRed": "800000",
    "darkYellow": "808000",
    "green": "00FF00",
    "lightGray": "C0C0C0",
    "magenta": "FF00FF",
    "red": "FF0000",
    "white": "FFFFFF",
    "yellow": "FFFF00",
}

# Colour names usable in borders and cells.
BORDER_COLORS = {
    "aqua": "00FFFF",
    "black": "000000",
    "blue": "0000FF",
    "fuchsia": "FF00FF",
    "gray": "808080",
    "green": "008000",
    "grey": "808080",
    "maroon": "800000",
    "navy": "000080",
    "olive": "808000",
    "orange": "FFA500",
    "purple": "800080",
    "red": "FF0000",
    "silver": "C0C0C0",
    "teal": "008080",
    "white": "FFFFFF",
    "windowtext": "000000",
    "yellow": "FFFF00",
}

# Colour names usable in formulas.
MATH_COLORS = {
    "aqua": "00FFFF",
    "black": "000000",
    "blue": "0000FF",
    "brown": "A52A2A",
    "cyan": "00FFFF",
    "darkblue": "00008B",
    "darkgray": "A9A9A9",
    "darkgreen": "006400",
    "darkgrey": "A9A9A9",
    "darkorange": "FF8C00",
    "darkred": "8B0000",
    "fuchsia": "FF00FF",
    "gold": "FFD700",
    "gray": "808080",
    "green": "008000",
    "grey": "808080",
    "indigo": "4B0082",
    "lightblue": "ADD8E6",
    "lightgray": "D3D3D3",
    "lightgrey": "D3D3D3",
    "lime": "00FF00",
    "magenta": "FF00FF",
    "maroon": "800000",
    "navy": "000080",
    "olive": "808000",
    "orange": "FFA500",
    "pink": "FFC0CB",
    "purple": "800080",
    "red": "FF0000",
    "silver": "C0C0C0",
    "teal": "008080",
    "violet": "EE82EE",
    "white": "FFFFFF",
    "yellow": "FFFF00",
}

# TeX control words a formula may not use, in alphabetical order.
DENIED_TEX = [
    "DeclareRobustCommand", "IfFileExists", "InputIfFileExists", "RequirePackage", "XeTeXpdffile", "XeTeXpicfile",
    "batchmode", "catcode", "closein", "closeout", "csname", "def", "detokenize", "edef", "endinput", "endlinechar",
    "expandafter", "font", "futurelet", "gdef", "immediate", "import", "include", "includegraphics", "input", "let",
    "lowercase", "lstinputlisting", "makeatletter", "meaning", "newcommand", "newread", "newwrite", "noexpand",
    "openin", "openout", "pdffiledump", "pdffilemoddate", "pdffilesize", "pdfmdfivesum", "pdfprimitive",
    "pdfrefximage", "pdfshellescape", "pdfximage", "primitive", "providecommand", "read", "readline", "renewcommand",
    "scantokens", "shellescape", "special", "string", "subfile", "uppercase", "usepackage", "verbatiminput", "write",
    "xdef",
]
RAW_TEX_FORMATS = ["tex", "latex", "context"]

# Inlines that must not be put in a colour box, and the longest boxed text in bytes.
UNBOXABLE = ["Image", "Link", "Code", "Math", "RawInline", "Note", "Cite", "LineBreak"]
MAX_BOXED_BYTES = 60

# Captions and listings.
CAPTION_STYLES = ["Caption", "TableCaption", "ImageCaption"]
PLACEHOLDERS = {"TOC_PLACEHOLDER": "toc", "TOF_PLACEHOLDER": "tof", "TOT_PLACEHOLDER": "tot"}
PLACEHOLDER_STYLES = ["BodyText", "FirstParagraph"]
LISTING_FIELDS = {"toc": 'TOC \\o "1-9" \\h \\z \\u', "tof": "TOC \\h \\z \\f F", "tot": "TOC \\h \\z \\f T"}
MAX_HEADING = 9
MAX_LIST_DEPTH = 4

# Histogram buckets.
CONVERSION_BUCKETS = [0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0]
SUBPROCESS_BUCKETS = [0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0]
POST_PROCESSING_BUCKETS = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]
RASTER_BUCKETS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0]
SIZE_BUCKETS = [1024, 10240, 102400, 1048576, 10485760, 104857600]

# Request policy.
PROTECTED_PREFIX = "/convert/"
PROTECTED_PATHS = ["/docx-template", "/pptx-template"]
DEFAULT_LIMIT_MB = 500
UNHEALTHY = ["unavailable", "unwritable", "unknown"]

# Order of table properties and of run properties in the office schema.
TABLE_PROPERTY_ORDER = [
    "tblStyle", "tblpPr", "tblOverlap", "bidiVisual", "tblStyleRowBandSize", "tblStyleColBandSize", "tblW", "jc",
    "tblCellSpacing", "tblInd", "tblBorders", "shd", "tblLayout", "tblCellMar", "tblLook", "tblCaption",
    "tblDescription",
]

# Steps a conversion can be told to take, and option prefixes that take a value.
REWRITES = [
    "page_break", "page_orientation", "heading_levels", "inline_styles", "docx_text_decorations",
    "docx_colors_to_latex", "docx_math_colors_to_latex", "docx_paragraphs_to_latex", "docx_lists_to_latex",
    "docx_tables_to_latex", "html_lists", "html_tables_to_latex", "html_captions", "docx_caption_labels_to_latex",
]
PLAIN_OPTIONS = ["--track-changes=all", "--pdf-engine=tectonic", "--toc"]
PREFIX_OPTIONS = ["--reference-doc="]

# Marks that carry properties through plain text.
PROPS_OPEN, PROPS_CLOSE = "\ue010", "\ue011"
LEVEL_OPEN, LEVEL_CLOSE = "\ue000", "\ue001"
