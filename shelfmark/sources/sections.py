"""Markdown documents to ``##`` sections, each judged for release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import let

# Fixed patterns: a bullet and the markers an unfilled template leaves behind.
BULLET = r"(?m)^-[ ]+\S"
MARKERS = (
    r"(?i)\b(?:TODO|TBD|CHANGEME)\b",
    r"\bPLACEHOLDER\b",
    r"(?i)[<\[{]{1,2}\s*placeholder\s*[>\]}]{1,2}",
)
MIN_SECTION_CHARS = 80


def has_marker(body: Column) -> Column:
    out = F.lit(False)
    for pattern in MARKERS:
        out = out | body.rlike(pattern)
    return out


def split_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, heading, body, unique, long_enough, has_bullet, unfilled, valid)."""
    pieces = F.split(text, r"(?m)^##[ ]+(?=\S)")
    # The first piece is whatever stands before the first heading.
    sections = F.transform(
        F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.struct(
            F.regexp_replace(F.regexp_extract(p, r"^([^\n]*)", 1), r"[ ]*\r?$", "").alias("heading"),
            F.regexp_replace(F.regexp_replace(p, r"^[^\n]*", ""), r"^\s+|\s+\z", "").alias("body"),
        ),
    )

    def judged(all_: Column) -> Column:
        """Equal headings are neighbours once sorted, so one sort tells which stand alone."""
        return F.transform(
            all_,
            lambda s, i: F.struct(
                F.when(
                    (s["heading"] == F.get(all_, i - 1)["heading"]) | (s["heading"] == F.get(all_, i + 1)["heading"]), False
                ).otherwise(True).alias("unique"),
                s["section"].alias("section"), s["heading"].alias("heading"), s["body"].alias("body"),
            ),
        )

    placed = F.transform(
        sections, lambda s, i: F.struct(s["heading"].alias("heading"), i.alias("section"), s["body"].alias("body"))
    )
    marked = F.array_sort(
        F.transform(
            let(F.array_sort(placed), judged),
            lambda s: F.struct(s["section"].alias("section"), s["heading"].alias("heading"), s["body"].alias("body"), s["unique"].alias("unique")),
        )
    )
    rows = docs.select(key, F.explode(marked).alias("_s")).select(key, F.col("_s.section").cast("int").alias("section"), "_s")
    body = F.col("_s.body")
    return rows.select(
        key, "section", "_s.heading", "_s.body", "_s.unique",
        (F.length(body) >= MIN_SECTION_CHARS).alias("long_enough"),
        body.rlike(BULLET).alias("has_bullet"),
        has_marker(body).alias("unfilled"),
    ).withColumn(
        "valid",
        F.col("unique") & F.col("long_enough") & F.col("has_bullet") & ~F.col("unfilled"),
    )
