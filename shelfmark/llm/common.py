"""What the operators share: the table they read and how texts reach numpy."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Word separators of every operator here: the space and the ASCII controls from tab to return.
BLANKS = " \t\n\u000b\f\r"
WORD_GAP = r"[\x20\x09-\x0D]+"

# Texts are handed to numpy in slices of about this many bytes, whatever the batch holds.
SLICE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; whatever else there is stays out."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def carried(docs: DataFrame, carry: bool, without: str | None = None) -> list[Column]:
    """The whole input row (but for one column, perhaps) as one struct named ``row``, if wanted."""
    return [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != without]).alias("row")] if carry else []


def carried_type(rows: DataFrame) -> str:
    """The part of a schema that names a carried ``row``."""
    return "".join(f"row {f.dataType.simpleString()}, " for f in rows.schema if f.name == "row")


def remainder(key: Column, divisor: int) -> Column:
    """``crc32`` of the key's decimal text, modulo ``divisor``: how held-out rows are told apart."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % divisor


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null text is empty."""
    return [value or b"" for value in column.cast(pa.large_binary()).to_pylist()]


def sliced(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Keys and text bytes of a batch (key first, text second), some ``limit`` bytes at a time."""
    keys, texts, size = [], [], 0
    for key, value in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
        keys.append(key)
        texts.append(value)
        size += len(value)
        if size >= limit:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts
