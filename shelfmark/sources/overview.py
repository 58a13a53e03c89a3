"""What a set of tables holds: columns, exact counts and the first rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions.text import clip_text


def _cell(df: DataFrame, name: str) -> Column:
    """Display text of a value: a blob shows its size, a whole double keeps its ``.0``."""
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit("("), F.octet_length(c).cast("string"), F.lit(" bytes)"))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def table_summary(tables: Mapping[str, DataFrame], max_cols: int | None = None) -> DataFrame:
    """(table_name, n_columns, columns, n_rows) of every table; ``max_cols`` shortens the list of names."""
    out = None
    for name in sorted(tables):
        df = tables[name]
        shown = ", ".join(df.columns[:max_cols])
        row = df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table_name"), F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
            F.lit(shown).alias("columns"), "n_rows",
        )
        out = row if out is None else out.unionByName(row)
    return out


def table_preview(
    df: DataFrame, *order: str, n: int = C.OVERVIEW_ROWS, max_cols: int | None = None, max_chars: int | None = None
) -> DataFrame:
    """First ``n`` rows in key order as display text; the limits shorten them where they are set."""
    cells = {c: _cell(df, c) for c in df.columns[:max_cols]}
    if max_chars is not None:
        cells = {c: clip_text(cell, max_chars) for c, cell in cells.items()}
    return df.orderBy(*order).limit(n).select(*[cell.alias(c) for c, cell in cells.items()])


def catalog_overview(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Summary of the catalogue's tables and how many tables and views there are."""
    listed = spark.catalog.listTables(database)
    tables = {t.name: spark.table(t.name if t.isTemporary else f"{t.database}.{t.name}") for t in listed}
    views = sum(1 for t in listed if t.tableType in ("VIEW", "TEMPORARY"))
    return table_summary(tables).withColumns({
        "tables": F.lit(len(listed) - views), "views": F.lit(views),
    })
