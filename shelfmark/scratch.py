"""Shared scratch space: where intermediate results are pinned.

A multi-pass operator must read the *same* rows twice even when an executor is
lost in between, so it writes its intermediate table to the shared folder that
the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a private temporary one only on a local master."""
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not (conf.get("spark.master") or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="shelfmark-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/shelfmark-{label}-{uuid.uuid4().hex}"


def pin(df: DataFrame, label: str = "pin") -> DataFrame:
    """Write ``df`` once and return a frame that reads the stored copy (lineage is cut)."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


