"""Outputs: JSON lines, Markdown tables and baseline files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions.text import md_escape
from ..operators.limits import truncation_note


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row; a number that is not finite becomes null."""
    fields = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        fields.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    json_rows(df).select(F.col("json").alias("value")).write.text(path)


def _line(cells: Sequence[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def gfm_table(
    df: DataFrame, order: Sequence[Column | str], columns: Sequence[str], n: int
) -> DataFrame:
    """(line_no, line) of a Markdown table over the first ``n`` rows, numbered from 1.

    The rows shown are bounded by ``n``, so numbering them in one place is safe; the total in the
    closing note is exact.
    """
    cells = [F.coalesce(md_escape(F.col(c).cast("string")), F.lit("")) for c in columns]
    top = df.orderBy(*order).limit(n)
    body = top.withColumn("_n", F.row_number().over(Window.orderBy(*order))).select(
        (F.col("_n") + 1).cast("bigint").alias("line_no"),
        _line([F.col("_n").cast("string"), *cells]).alias("line"),
    )
    spark = df.sparkSession
    head = spark.range(2).select(
        F.col("id").alias("line_no"),
        F.when(F.col("id") == 0, _line([F.lit("#"), *[md_escape(F.lit(c)) for c in columns]]))
        .otherwise(F.lit("|" + " --- |" * (len(columns) + 1))).alias("line"),
    )
    total = df.agg(F.count("*").alias("_t"))
    note = total.select(
        F.lit(n + 2).cast("bigint").alias("line_no"),
        truncation_note(F.lit(n), F.col("_t")).alias("line"),
    ).filter("line IS NOT NULL")
    return head.unionByName(body).unionByName(note)


class DriftTooHigh(RuntimeError):
    """The machine moved during the run, so its numbers must not become a baseline."""


def check_drift(drift: float, limit: float = C.MAX_DRIFT) -> None:
    if drift > limit:
        raise DriftTooHigh(f"drift {drift:.0%} is over the limit of {limit:.0%}")


def baseline_lines(passed: DataFrame, key: str, reasons: DataFrame | None = None) -> DataFrame:
    """Distinct keys as baseline lines; a hand-written reason (key, reason) is carried over."""
    keys = passed.select(F.col(key).alias("key")).distinct()
    if reasons is None:
        return keys.select("key", F.col("key").alias("line"))
    # A key stands on one line, however often a reason is given for it.
    reasons = reasons.groupBy("key").agg(F.min(F.nullif("reason", F.lit(""))).alias("reason"))
    joined = keys.join(reasons, "key", "left")
    with_reason = F.concat("key", F.lit("  # "), "reason")
    return joined.select(
        "key",
        F.when(F.coalesce("reason", F.lit("")) != "", with_reason).otherwise(F.col("key")).alias("line"),
    )


def write_baseline(
    passed: DataFrame, key: str, path: str, *, drift: float = 0.0, reasons: DataFrame | None = None
) -> None:
    """Write the sorted, distinct pass set; refused when drift is too high.

    Rows are range-partitioned, so part files in name order are one sorted list.
    """
    check_drift(drift)
    lines = baseline_lines(passed, key, reasons)
    lines.repartitionByRange("key").sortWithinPartitions("key").select(
        F.col("line").alias("value")
    ).write.text(path)
