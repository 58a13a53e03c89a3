"""HTML pages to visible text and to element rows, by one left-to-right scan."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import collapse_ws, decode_entities

# One scanner for all functions, as parts of regular expressions.  What stands in a tag: white space and
# slashes, or a name with or without a value; a quoted value may hold ``>``, a quote that never
# closes makes the whole no tag.  Every loop is possessive, so a page is read once from left to right.
_WS = r"[ \t\n\f\r]"
_ITEM = (
    rf"(?:(?:{_WS}|/)++|[^ \t\n\f\r=>/]++"
    rf"(?:{_WS}*+={_WS}*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^ \t\n\f\r>]*+)|(?!{_WS}*+=))|=)"
)
_NAME_END = r"(?![a-z0-9])"
_REST = rf"{_ITEM}*+>"
_TAG = rf"</?[a-z0-9]++{_REST}"

# What a page shows in none of its elements, in the order in which it is tried at each ``<``: comments, bodies
# of these four elements up to their own close tag, declarations.  Then tags, and a ``<`` that opens none.
_SCAN = (
    rf"(?is)<!--.*?(?:-->|\z)|<(style|script|svg|title){_NAME_END}{_REST}.*?(?:</\1[^>]*+(?:>|\z)|\z)"
    rf"|<![^>]*+(?:>|\z)|({_TAG})|(<)"
)
# A seam stands in front of every tag, behind every other ``<`` and for what was left out: so later patterns
# know a tag from a ``<`` inside a value, and nothing that was no tag becomes one.
_SEAM = "\u0001"
_BLOCKS = (
    "p|figcaption|h[1-6]|div|section|article|main|figure|header|footer|details|center"
    "|summary|blockquote|ul|ol|li|table|tr|td|th"
)
_BLOCK_TAG = rf"(?is){_SEAM}<(?:/?(?:{_BLOCKS})|br|hr){_NAME_END}{_REST}"
_ANY_TAG = rf"(?is){_SEAM}{_TAG}"


def _open(names: str) -> str:
    return rf"{_SEAM}<(?:{names}){_NAME_END}{_REST}"


def _until(names: str) -> str:
    """What follows an opening tag, up to the next tag of these names or the end of the page."""
    return rf"[^{_SEAM}]*+(?:(?!{_SEAM}</?(?:{names}){_NAME_END}){_SEAM}[^{_SEAM}]*+)*+"


def drop_invisible(html: Column) -> Column:
    """The page without comments, declarations and skipped bodies, its tags and seams marked.

    The seam's own character is left out wherever the page has it.
    """
    return F.regexp_replace(F.replace(html, F.lit(_SEAM), F.lit("")), _SCAN, f"$3{_SEAM}$2")


def visible_text(visible: Column) -> Column:
    """Text of a page that went through ``drop_invisible``."""
    blocks = F.regexp_replace(visible, r"[ \t\r\n]+", " ")
    blocks = F.regexp_replace(blocks, _BLOCK_TAG, "\n")
    text = decode_entities(F.regexp_replace(blocks, _ANY_TAG, _SEAM))
    text = F.replace(text, F.lit(_SEAM), F.lit(""))
    text = F.regexp_replace(text, r" *\n[ \n]*", "\n")
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")


def html_text(html: Column) -> Column:
    """Visible text: one line per block, entities decoded once, white space collapsed.

    An inline tag leaves a seam until entities are decoded, so two halves of text
    never spell an entity that the page did not contain.
    """
    return visible_text(drop_invisible(html))


def inner_text(fragment: Column) -> Column:
    """Text of one element body on a single line."""
    bare = F.replace(
        decode_entities(F.regexp_replace(fragment, _ANY_TAG, _SEAM)), F.lit(_SEAM), F.lit("")
    )
    return F.trim(collapse_ws(bare))


def attribute(tag: Column, name: str) -> Column:
    """Decoded first attribute of that name in one opening tag; empty without a value, NULL when it is absent."""
    end = r"(?=[ \t\n\f\r=>/])"
    pattern = (
        rf"(?is)^{_SEAM}<[a-z0-9]++(?:(?!{name}{end}){_ITEM})*+{name}{end}"
        rf"(?:{_WS}*+={_WS}*+(\"[^\"]*+\"|'[^']*+'|[^ \t\n\f\r>]*+))?+"
    )
    value = F.regexp_replace(F.regexp_extract(tag, pattern, 1), r"""(?s)^(["'])(.*)\1$""", "$2")
    return F.when(tag.rlike(pattern), decode_entities(value))


# The element functions below take a page that went through ``drop_invisible``.


def link_count(visible: Column) -> Column:
    """How many anchors of a page have a target."""
    return F.regexp_count(visible, F.lit(rf"(?is){_SEAM}<a{_NAME_END}(?:(?!href(?=[ \t\n\f\r=>/])){_ITEM})*+href"))


def headings(visible: Column) -> Column:
    """(level, text) of every heading, in page order; any block tag ends one."""
    bodies = F.regexp_extract_all(visible, F.lit(rf"(?is)({_open('h[1-6]')}{_until(_BLOCKS + '|hr')})"), F.lit(1))
    return F.transform(
        bodies,
        lambda b: F.struct(F.substring(b, 4, 1).cast("int").alias("level"), inner_text(b).alias("text")),
    )


def links(visible: Column) -> Column:
    """(href, text) of every anchor that has a target, in page order.

    A link goes up to its close tag, the next anchor or the end of the page.
    """
    bodies = F.regexp_extract_all(visible, F.lit(rf"(?is)({_open('a')}{_until('a')})"), F.lit(1))
    rows = F.transform(bodies, lambda b: F.struct(attribute(b, "href").alias("href"), inner_text(b).alias("text")))
    return F.filter(rows, lambda r: r["href"].isNotNull())


def images(visible: Column) -> Column:
    """(src, alt, width) of every image with a source; width keeps its unit (``px`` or ``%``)."""
    tags = F.regexp_extract_all(visible, F.lit(rf"(?is)({_open('img')})"), F.lit(1))

    def width(tag: Column) -> Column:
        raw = F.trim(attribute(tag, "width"))
        percent = F.regexp_extract(raw, r"^(\d+)\s*%$", 1).try_cast("int")
        pixels = F.regexp_extract(raw, r"^(\d+)", 1).try_cast("int")

        def clamp(value: Column, top: int) -> Column:
            return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(1)), F.lit(top)))

        return F.when(
            raw.endswith("%"), F.concat(clamp(percent, 100).cast("string"), F.lit("%"))
        ).otherwise(F.concat(clamp(pixels, 4000).cast("string"), F.lit("px")))

    rows = F.transform(
        tags,
        lambda t: F.struct(
            attribute(t, "src").alias("src"),
            F.coalesce(attribute(t, "alt"), F.lit("")).alias("alt"),
            width(t).alias("width"),
        ),
    )
    return F.filter(rows, lambda r: F.coalesce(r["src"], F.lit("")) != "")


def table_cells(visible: Column) -> Column:
    """(row, col, header, text) of every table cell; rows count over the whole page from 0.

    Rows and cells end at their close tag or where the next one begins.
    """
    rows = F.regexp_extract_all(visible, F.lit(rf"(?is){_open('tr')}({_until('tr|table')})"), F.lit(1))
    cell = rf"(?is)({_open('t[dh]')}{_until('t[dh]')})"

    def cells(row: Column, r: Column) -> Column:
        return F.transform(
            F.regexp_extract_all(row, F.lit(cell), F.lit(1)),
            lambda c, i: F.struct(
                r.cast("int").alias("row"),
                i.cast("int").alias("col"),
                c.rlike(f"^{_SEAM}<(?i:th)").alias("header"),
                inner_text(c).alias("text"),
            ),
        )

    return F.flatten(F.transform(rows, cells))


def page_language(html: Column) -> Column:
    return F.lower(F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z-]+)""", 1))


def has_headings(html: Column) -> Column:
    return html.rlike(r"(?i)<h[1-6]")


def has_remote_images(html: Column) -> Column:
    return html.rlike(r"(?i)<img") & html.rlike(r"""(?i)src=(?:"|')?http""")
