"""Archive directories: names and sizes, nothing extracted."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

ENTRY_COLUMNS = "ord int, name string, is_dir boolean, size bigint"


def _name(info: zipfile.ZipInfo) -> str:
    """Prefer UTF-8 even when the entry does not say so."""
    if info.flag_bits & 0x800:
        return info.filename
    try:
        return info.orig_filename.encode("cp437").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return info.filename


def _entries(content: bytes) -> list[tuple[str, bool, int]]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            infos = archive.infolist()
    except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError):
        return []
    return [(_name(i), i.is_dir(), i.file_size) for i in infos]


def list_archives(
    files: DataFrame, key: str, content: str, limit: int | None = None
) -> DataFrame:
    """(key, ord, name, is_dir, size) of every ZIP-family file; anything else gives no row.

    With a ``limit`` on the entries of a file, its ``total`` and a ``truncated`` flag come along.  The directory is read batch by batch in Arrow; only rows with a ZIP signature get there.
    """
    head = F.hex(F.substring(F.col(content), 1, 4))
    zips = files.filter(head.isin("504B0304", "504B0506", "504B0708")).select(key, content)
    flagged = limit is not None
    schema = ENTRY_COLUMNS + (", total bigint, truncated boolean" if flagged else "")
    key_type = files.schema[key].dataType.simpleString()

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, data in zip(batch.column(key), batch.column(content)):
                rows = _entries(data.as_py())
                total, rows = len(rows), rows[:limit]
                more = [pa.array([total] * len(rows), pa.int64()), pa.array([total > len(rows)] * len(rows), pa.bool_())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([owner.as_py()] * len(rows), batch.schema.field(key).type),
                        pa.array(range(len(rows)), pa.int32()),
                        pa.array([r[0] for r in rows], pa.string()),
                        pa.array([r[1] for r in rows], pa.bool_()),
                        pa.array([r[2] for r in rows], pa.int64()),
                        *(more if flagged else []),
                    ],
                    names=[key, "ord", "name", "is_dir", "size", *(["total", "truncated"] if flagged else [])],
                )

    return zips.mapInArrow(listing, f"{key} {key_type}, {schema}")


def scan_archives(spark: SparkSession, path: str) -> DataFrame:
    """Directories of the archives below a folder.

    Every file is its own unit of work, so a few large archives do not pile up in one task.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select(F.col("path").alias("archive_id"), "content")
    )
    return list_archives(files, "archive_id", "content")
