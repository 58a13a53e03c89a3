"""Estate-shaped tables that Spark derives from the given ones, row by row.

The SQL fragments are plain enough for any engine, so a query and its SQL twin start from the
same derived rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .registry import table


def case_of(selector: str, values: list[str]) -> str:
    """CASE that picks one of ``values`` by ``selector`` modulo their number."""
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE ({selector}) % {len(values)} {arms} END)"


PART_EXT = case_of("p_partkey", [
    "jpg", "PNG", "mp3", "pdf", "zip", "nef", "mkv", "epub", "txt", "md", "xyz", "csv", "Flac",
    "ipynb", "rs", "7z", "gif",
])
PART_FILES = {
    "ord": "p_partkey",
    "path": (
        "'/lib/' || lower(p_brand) || '/' || replace(p_name, ' ', '_') || p_partkey % 40 || '.' || "
        + PART_EXT
    ),
    "length": "CAST(p_size * 1000003 + p_partkey AS BIGINT)",
    "mtime": "CAST(1700000000 + p_partkey * 61 AS BIGINT)",
}

# Order lines as archive entries.
ENTRY_EXT = case_of("l_partkey + l_suppkey", ["jpg", "png", "jp2", "txt", "webp", "jpg", "gif", "tif"])
ENTRY_STEM = case_of("l_partkey", [
    "page", "Page ", "cover", "credits", "group logo", "[extra] page", "p", "back-Cover", "thumbs",
])
LINE_ENTRIES = {
    "archive_id": "l_orderkey",
    "ord": "CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 1000000 + l_suppkey",
    "name": (
        "(CASE WHEN l_partkey % 23 = 0 THEN '__MACOSX/' ELSE 'vol' || l_suppkey % 3 || '/' END) || "
        + ENTRY_STEM + " || l_linenumber * (l_suppkey % 30) || '.' || " + ENTRY_EXT
    ),
    "is_dir": "l_partkey % 29 = 0",
    "size": "CAST(l_quantity * 750000 AS BIGINT)",
}

# Events as timed runs of samples.
EVENT_RUNS = {
    "ord": "event_id",
    "name": "'sample-' || user_id || '.' || " + case_of("user_id", ["jpg", "png", "avif", "dds", "psd", "exr", "gif"]),
    "ext": case_of("user_id", ["jpg", "png", "avif", "dds", "psd", "exr", "gif"]),
    "tier": case_of("event_id", ["small", "medium", "large", "single", "huge"]),
    "ms": "CASE WHEN event_type = 'error' THEN NULL ELSE value * 4 END",
    "peer_ms": "CASE WHEN user_id % 5 = 0 THEN NULL ELSE CAST(1 + user_id % 37 AS DOUBLE) END",
}


def select_list(fragments: dict[str, str]) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in fragments.items())


def cte(name: str, source: str, fragments: dict[str, str]) -> str:
    """A common table expression of the derived table, for the SQL twin."""
    return f"{name} AS (SELECT {select_list(fragments)} FROM {source})"


def derive(spark: SparkSession, sf_dir: str, source: str, fragments: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, source).selectExpr(*[f"{e} AS {n}" for n, e in fragments.items()])


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "part", PART_FILES)


def line_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "lineitem", LINE_ENTRIES)


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "events", EVENT_RUNS)


FILES_CTE = cte("files", "part", PART_FILES)
ENTRIES_CTE = cte("entries", "lineitem", LINE_ENTRIES)
RUNS_CTE = cte("runs", "events", EVENT_RUNS)
