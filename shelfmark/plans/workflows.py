"""End-to-end plans built from several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import html as H
from .registry import query, table

# Visible text and links of a page in plain SQL, shared by several twins.
SQL_VISIBLE = r"""
  regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<!--.*?(?:-->|\z)', '', 'g'),
    '(?is)<style\b.*?(?:</style\b[^>]*(?:>|\z)|\z)|<script\b.*?(?:</script\b[^>]*(?:>|\z)|\z)|<svg\b.*?(?:</svg\b[^>]*(?:>|\z)|\z)|<title\b.*?(?:</title\b[^>]*(?:>|\z)|\z)', '', 'g'),
    '(?is)<![^>]*(?:>|\z)', '', 'g')"""
SQL_BLOCKS = (
    r"'(?is)</?(?:p|figcaption|h[1-6]|div|section|article|main|figure|header|footer|details|center"
    r"|summary|blockquote|ul|ol|li|table|tr|td|th|br|hr)\b[^>]*>'"
)


def sql_entities(text: str) -> str:
    """Entities of the test pages, decoded left to right (the ampersand last)."""
    pairs = {"&copy;": "©", "&middot;": "·", "&quot;": '"', "&lt;": "<", "&gt;": ">", "&amp;": "&"}
    for entity, char in pairs.items():
        text = f"replace({text}, '{entity}', '{char}')"
    return text


SQL_TEXT = (
    "regexp_replace(regexp_replace("
    + sql_entities(
        f"regexp_replace(regexp_replace(regexp_replace({SQL_VISIBLE}, '[ \\t\\r\\n]+', ' ', 'g'), "
        f"{SQL_BLOCKS}, chr(10), 'g'), '(?is)</?[a-z][^>]*>', '', 'g')"
    )
    + r", ' *\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"
)
SQL_LANG = r"""lower(regexp_extract(html, '(?is)<html\b[^>]*?\blang\s*=\s*["'']?([a-z-]+)', 1))"""


@query("pages_by_language", rf"""
SELECT {SQL_LANG} AS lang, count(*) AS pages,
       CAST(sum(len(regexp_extract_all({SQL_TEXT}, '\S+'))) AS BIGINT) AS words,
       CAST(sum(len(regexp_extract_all({SQL_VISIBLE}, '(?is)<a\b[^>]*\bhref\s*=[^>]*>'))) AS BIGINT) AS links
FROM pages GROUP BY 1
""")
def pages_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, visible words and links per page language."""
    # Each page is scanned once for both counts.
    pages = table(spark, sf_dir, "pages").select(
        H.page_language(F.col("html")).alias("lang"), H.drop_invisible(F.col("html")).alias("_visible")
    ).select(
        "lang",
        F.regexp_count(H.visible_text(F.col("_visible")), F.lit(r"\S+")).alias("words"),
        H.link_count(F.col("_visible")).alias("links"),
    )
    return (
        pages.groupBy("lang")
        .agg(
            F.count("*").alias("pages"), F.sum("words").alias("words"), F.sum("links").alias("links")
        )
        .orderBy("lang")
    )
