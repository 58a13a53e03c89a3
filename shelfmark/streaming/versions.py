"""A stream of file versions: new files and rewritten ones."""

from __future__ import annotations

import fnmatch
import re
import time
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.files import identity

IDENTITY = ("id_path", "id_length", "id_mtime")
LISTED = "path string, modificationTime timestamp, length bigint"
_ARROW = pa.schema([
    ("path", pa.string()), ("modificationTime", pa.timestamp("us", tz="UTC")), ("length", pa.int64()),
])
# Folders are opened from the top until there are so many to list side by side.
SIDE_BY_SIDE = 256


def _open(root: str) -> tuple[pa_fs.FileSystem, str, str]:
    """The file system of a path, the path inside it, and what stands in front of paths in results."""
    store = re.match(r"(?!file:)[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", root)
    if store is None:
        return pa_fs.LocalFileSystem(), re.sub(r"^file:/+", "/", root).rstrip("/") or "/", "file:"
    system, inside = pa_fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", root))
    # Object stores name a path by its bucket, which the front already holds.
    front = store.group()
    bucket = front.split("://")[1]
    return system, inside.rstrip("/") or "/", front.removesuffix(bucket) if inside.startswith(bucket) else front


def _hidden(name: str) -> bool:
    """Spark's readers leave these out as well."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def _entries(system: pa_fs.FileSystem, folder: str) -> tuple[list[pa_fs.FileInfo], list[str]]:
    """Files and folders directly inside a folder; none if it has gone."""
    found = system.get_file_info(pa_fs.FileSelector(folder, allow_not_found=True))
    seen = [f for f in found if not _hidden(f.base_name)]
    return (
        [f for f in seen if f.type == pa_fs.FileType.File],
        [f.path for f in seen if f.type == pa_fs.FileType.Directory],
    )


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool) -> None:
        self.path = path
        self.deep = deep


class _Listing(DataSourceStreamReader):
    """Every batch lists the tree as it is; the offset is the time of the look."""

    def __init__(self, root: str, glob: str) -> None:
        self.root = root
        self.glob = glob

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        system, top, _ = _open(self.root)
        opened, waiting = [], [top]
        while waiting and len(waiting) < SIDE_BY_SIDE:
            level = waiting
            waiting = [f for folder in level for f in _entries(system, folder)[1]]
            opened += level
        return [_Folder(f, False) for f in opened] + [_Folder(f, True) for f in waiting]

    def read(self, partition: _Folder) -> Iterator[pa.RecordBatch]:
        system, _, front = _open(self.root)
        waiting = [partition.path]
        while waiting:
            files, folders = _entries(system, waiting.pop())
            if partition.deep:
                waiting += folders
            files = [f for f in files if fnmatch.fnmatchcase(f.base_name, self.glob)]
            for at in range(0, len(files), 10_000):
                part = files[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array([front + f.path for f in part], pa.string()),
                    pa.array([f.mtime_ns // 1000 for f in part], pa.int64()).cast(_ARROW.field(1).type),
                    pa.array([f.size for f in part], pa.int64()),
                ], schema=_ARROW)


class FolderListing(DataSource):
    """Stream source ``folder_listing``: the files below ``path`` at every trigger."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return LISTED

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Listing(self.options["path"], self.options.get("glob", "*"))


def file_versions(spark: SparkSession, source: str, *, glob: str | None = None) -> DataFrame:
    """Stream of (path, modificationTime, length) and identity: each version of each file once.

    Executors list the folders; the state store keeps the identities, so a rewritten file, whose
    length or second of change differs, is a new row at the next trigger.  Every trigger is a look
    at the whole tree: give a query a processing time.
    """
    spark.dataSource.register(FolderListing)
    reader = spark.readStream.format("folder_listing")
    if glob:
        reader = reader.option("glob", glob)
    return identity(reader.load(source)).dropDuplicates(list(IDENTITY))


__all__ = ["FolderListing", "IDENTITY", "file_versions"]
