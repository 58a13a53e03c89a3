"""Incremental catalogue: only new or rewritten files are handed on."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.files import identity
from .versions import IDENTITY, file_versions


def new_files(batch: DataFrame, catalog: DataFrame | None) -> DataFrame:
    """Files of a batch whose (path, length, mtime) the catalogue has not recorded."""
    fresh = identity(batch).dropDuplicates(list(IDENTITY))
    if catalog is None:
        return fresh
    return fresh.join(catalog.select(*IDENTITY), list(IDENTITY), "left_anti")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored catalogue; none if its folder does not exist, an error if it cannot be read."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def start_catalog(
    spark: SparkSession, source: str, catalog: str, checkpoint: str, *,
    glob: str | None = None, every: str | None = None,
):
    """Stream new and rewritten files of a folder into a catalogue table.

    Without ``every`` the folder is looked at once; with it (``"10 minutes"``) again and again.
    Every batch is compared with the stored identities and writes its own folder, so a retried
    batch replaces itself, and a catalogue survives the loss of its checkpoint.
    """
    files = file_versions(spark, source, glob=glob).select("path", "modificationTime", "length")
    trigger = {"processingTime": every} if every else {"availableNow": True}

    def record(batch: DataFrame, batch_id: int) -> None:
        target = f"{catalog}/batch={batch_id}"
        known = _stored(batch.sparkSession, catalog)
        if known is not None and "batch" in known.columns:
            known = known.filter(F.col("batch") != batch_id)
        new_files(batch, known).write.mode("overwrite").parquet(target)

    return (
        files.writeStream.foreachBatch(record)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def catalog_rescan(spark: SparkSession, source: str, catalog: str) -> DataFrame:
    """Batch twin for a nightly rescan: everything below a folder the catalogue does not hold."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
        .select("path", "modificationTime", "length")
    )
    return new_files(files, _stored(spark, catalog))
