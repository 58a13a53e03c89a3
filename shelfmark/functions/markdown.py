"""Markdown documents to block rows: one pass per document, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .arrays import let
from .paths import language_from_fence

# Pieces of a document in order of preference: fixed patterns.
# front matter, backtick fence, tilde fence (an unclosed one runs to the end), then single lines.
_FRONT = r"\A---[ \t]*\r?\n(?s:.*?)^---[ \t]*(?:\r?\n|\z)"
_TICKS = r"^ {0,3}(`{3,})[^`\r\n]*\r?(?:\n(?s:.*?)(?:^ {0,3}\2`*[ \t]*(?:\r?\n|\z)|\z)|\z)"
_TILDES = r"^ {0,3}(~{3,})[^\r\n]*\r?(?:\n(?s:.*?)(?:^ {0,3}\3~*[ \t]*(?:\r?\n|\z)|\z)|\z)"
# A header line, a line of dashes with a pipe, and the lines with a pipe that follow.
_DASHES = r" {0,3}(?=[^\r\n]*\|)\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*(?:\r?\n|\z)"
_TABLE = rf"^[^\r\n]*\|[^\r\n]*\r?\n{_DASHES}(?:^[^\r\n]*\|[^\r\n]*(?:\r?\n|\z))*"
# A line of text that is underlined.
_UNDERLINED = (
    r"^ {0,3}(?!#{1,6}[ \t]|>|[-*+][ \t]|\d{1,9}[.)][ \t]|(?:-[ \t]*){3,}$|\s)[^\r\n]+\r?\n"
    r" {0,3}(?:=+|-+)[ \t]*(?:\r?\n|\z)"
)
# Indented lines behind an empty one.
_INDENTED = r"(?<![^\r\n]\r?\n)(?:^(?: {4}|\t)(?!\s*(?:[-*+]|\d{1,9}[.)])[ \t])[^\r\n]*\S[^\r\n]*(?:\r?\n|\z))+"
_PIECE = rf"(?m)({_FRONT}|{_TICKS}|{_TILDES}|{_TABLE}|{_UNDERLINED}|{_INDENTED}|^[^\r\n]*(?:\r?\n|\z))"


def _piece_kind(piece: Column, ord_: Column, before: Column) -> Column:
    fence = r"^ {0,3}(?:```|~~~)"
    several = piece.rlike(r"\n[^\n]")
    behind_blank = before.isNull() | before.rlike(r"^\s*$")
    item = r"^\s*(?:[-*+]|\d{1,9}[.)])[ \t]"
    # Most lines start with a letter and are plain text.
    return (
        F.when(~several & piece.rlike(r"^ {0,3}\p{L}"), "para")
        .when((ord_ == 0) & piece.rlike(r"(?s)\A---[ \t]*\r?\n.*^?---[ \t]*\r?\n?\z"), "front")
        .when(piece.rlike(fence), "code")
        .when(several & piece.rlike(rf"(?m)\A{_TABLE}\z"), "table")
        .when(several & piece.rlike(rf"(?m)\A{_UNDERLINED}\z"), "underlined")
        .when(piece.rlike(r"^(?: {4}|\t)[^\r\n]*\S") & ~piece.rlike(item) & behind_blank, "indented")
        .when(piece.rlike(r"^\s*$"), "blank")
        .when(piece.rlike(r"^ {0,3}#{1,6}(?:[ \t]|\r?\n|$)"), "heading")
        .when(piece.rlike(r"^ {0,3}(?:-[ \t]*){3,}\r?\n?$|^ {0,3}(?:\*[ \t]*){3,}\r?\n?$|^ {0,3}(?:_[ \t]*){3,}\r?\n?$"), "rule")
        .when(piece.rlike(r"^ {0,3}>"), "quote")
        .when(piece.rlike(item), "item")
        .when(piece.rlike(r"^ {0,3}!\[[^\]]*\]\([^)]*\)\s*$"), "image")
        .otherwise("para")
    )


def _fence_body(piece: Column) -> Column:
    opened = F.regexp_replace(piece, r"^[^\n]*(?:\n|\z)", "")
    closed = F.regexp_replace(opened, r"(?:^|\n) {0,3}(?:`{3,}|~{3,})[ \t]*\r?\n?\z", "")
    return F.regexp_replace(closed, r"\n+\z", "")


def md_blocks(text: Column) -> Column:
    """Blocks of a Markdown text: (kind, level, text, lang, task, cells).

    A pipe table is one block: ``cells`` has its header and its rows.  ``level`` is the heading level, or the nesting depth of a list item; ``task`` is the state
    of a task item.  Inline emphasis is left as written.
    """
    pieces = F.filter(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(1)), lambda p: p != "")
    kinds = F.filter(
        let(
            pieces,
            lambda all_: F.transform(
                all_, lambda p, i: F.struct(p.alias("piece"), _piece_kind(p, i, F.get(all_, i - 1)).alias("kind"))
            ),
        ),
        lambda k: k["kind"] != "blank",
    )

    def block(entry: Column) -> Column:
        piece, kind = entry["piece"], entry["kind"]
        line = F.regexp_replace(piece, r"\s+\z", "")
        tag = F.regexp_extract(piece, r"^ {0,3}(?:`{3,}|~{3,})[ \t]*([^\s`]*)", 1)
        indent = F.length(F.regexp_extract(F.replace(piece, F.lit("\t"), F.lit("    ")), "^( *)", 1))
        item = F.regexp_replace(line, r"^\s*(?:[-*+]|\d{1,9}[.)])[ \t]+", "")
        mark = F.lower(F.regexp_extract(item, r"^\[([ xX])\](?:\s|$)", 1))
        level = (
            F.when(kind == "heading", F.length(F.regexp_extract(piece, r"^ {0,3}(#{1,6})", 1)))
            .when(kind == "underlined", F.when(line.endswith("="), 1).otherwise(2))
            .when(kind == "item", (indent / 2).cast("int") + 1)
        )
        body = (
            F.when(kind == "front", F.regexp_replace(
                F.regexp_replace(piece, r"\A---[ \t]*\r?\n", ""), r"(?:\A|\n)---[ \t]*\r?\n?\z", ""))
            .when(kind == "code", _fence_body(piece))
            .when(kind == "indented", F.regexp_replace(line, r"(?m)^(?: {4}|\t)", ""))
            .when(kind == "underlined", F.trim(F.regexp_replace(line, r"\s*\n[^\n]*\z", "")))
            .when(kind == "table", F.regexp_replace(line, r"\r\n", "\n"))
            .when(kind == "heading", F.regexp_replace(
                F.regexp_replace(line, r"^ {0,3}#{1,6}[ \t]*", ""), r"(?:^|[ \t]+)#+$", ""))
            .when(kind == "quote", F.regexp_replace(line, r"^ {0,3}>[ \t]?", ""))
            .when(kind == "item", F.regexp_replace(item, r"^\[[ xX]\]\s*", ""))
            .when(kind == "rule", F.lit(""))
            .otherwise(F.trim(line))
        )
        return F.struct(
            F.when(kind == "underlined", "heading").when(kind == "indented", "code").otherwise(kind).alias("kind"),
            level.cast("int").alias("level"),
            body.alias("text"),
            F.when(kind == "front", "yaml").when(kind.isin("code", "indented"), language_from_fence(tag)).alias("lang"),
            F.when((kind == "item") & (mark != ""), mark == "x").alias("task"),
            F.when(kind == "table", _table_cells(line)).alias("cells"),
        )

    return F.filter(
        F.transform(kinds, block), lambda b: ~((b["kind"] == "code") & (b["text"] == ""))
    )


def _table_cells(table: Column) -> Column:
    lines = F.split(table, r"\r?\n")
    return F.transform(F.filter(lines, lambda l, i: i != 1), table_row)


def table_row(line: Column) -> Column:
    """Cells of one pipe-table line; an escaped pipe stays inside its cell."""
    inner = F.regexp_replace(F.trim(line), r"^\||(?<!\\)\|$", "")
    return F.transform(
        F.split(inner, r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit(r"\|"), F.lit("|"))
    )
