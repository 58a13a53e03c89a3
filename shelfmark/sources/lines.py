"""Line formats: baselines, measurements and locale files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import text_lines


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, line) of every text file below ``path``; whole files keep their line order."""
    docs = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), F.col("value")
    )
    return docs.select("file", F.posexplode(text_lines(F.col("value"))).alias("ord", "line"))


def scan_baseline(lines: DataFrame, line: str = "line") -> DataFrame:
    """``key value # reason`` lines to (key, value, reason, unexplained); blanks and comments go.

    Other columns of the input are kept.
    """
    text = F.trim(F.col(line))
    rest = [c for c in lines.columns if c != line]
    body = F.trim(F.split_part(text, F.lit("#"), F.lit(1)))
    reason = F.trim(F.regexp_extract(text, r"#(.*)$", 1))
    return (
        lines.filter((text != "") & ~text.startswith("#"))
        .select(
            *rest,
            F.regexp_extract(body, r"^(\S+)", 1).alias("key"),
            F.regexp_extract(body, r"^\S+\s+(\S+)", 1).try_cast("double").alias("value"),
            reason.alias("reason"), (reason == "").alias("unexplained"),
        )
    )


def scan_measurements(lines: DataFrame, line: str = "line") -> DataFrame:
    """``name<TAB>ms`` lines to (name, ms, status); FAIL stays a row and never counts as fast."""
    parts = F.split(F.col(line), "\t")
    rest = [c for c in lines.columns if c != line]
    ms = F.get(parts, 1).try_cast("double")
    return lines.filter(F.size(parts) >= 2).select(
        *rest, F.get(parts, 0).alias("name"), ms.alias("ms"),
        F.when(ms.isNull(), "FAIL").otherwise("ok").alias("status"),
    )


_ENTRY = r'^([A-Za-z0-9_]+)\s*=\s*"(.*)"\s*$'


def locale_entry(line: Column) -> Column:
    """(key, value) of a flat ``key = "value"`` line, NULL for any other line."""
    return F.when(
        line.rlike(_ENTRY),
        F.struct(
            F.regexp_extract(line, _ENTRY, 1).alias("key"), F.regexp_extract(line, _ENTRY, 2).alias("value")
        ),
    )


def scan_locales(lines: DataFrame, file: str = "file", line: str = "line") -> DataFrame:
    """(locale, ord, key, value) with repeated keys kept; the file name is the locale."""
    return (
        lines.select(
            F.regexp_replace(file, r"\.[^.]*$", "").alias("locale"), "ord",
            locale_entry(F.col(line)).alias("_e"),
        )
        .filter("_e IS NOT NULL")
        .select("locale", "ord", "_e.*")
    )
