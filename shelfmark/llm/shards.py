"""Shards by jump consistent hashing: no ring table, and only the needed rows move when one is added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SHARDS = 40


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a stable key among ``shards``.

    The key draws a sequence of numbers in (0, 1]; each sends it on from shard ``b`` to shard
    ``floor((b + 1) / draw)``, until the next one does not exist.  The draws do not depend on the
    number of shards, so one more shard takes over exactly the keys that jump to it.  A null key
    is a key like others.
    """

    def step(at: Column, n: Column) -> Column:
        draw = (F.shiftrightunsigned(F.xxhash64(key, n), 11) + 1) / F.lit(float(1 << 53))
        ahead = F.floor(F.least((at.ahead + 1) / draw, F.lit(float(shards))))
        jumped = F.struct(at.ahead.alias("shard"), ahead.cast("long").alias("ahead"))
        return F.when(at.ahead < shards, jumped).otherwise(at)

    begin = F.struct(F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("ahead"))
    # Each step goes at least one shard further.
    steps = F.sequence(F.lit(1), F.lit(shards))
    return F.aggregate(steps, begin, step, lambda at: at.shard.cast("int"))


def with_slots(rows: DataFrame, key: str, order: list[str], parts: int) -> DataFrame:
    """Number the rows of each shard without gaps from 0, as ``slot``.

    A shard of any size is cut into ``parts`` by the key's hash; rows are numbered within their
    part, and a table of one row for each part says how many stand before it.
    """
    part = F.pmod(F.xxhash64(F.lit("slot"), F.col(key)), F.lit(parts)).cast("int")
    cut = rows.withColumn("part", part)
    counts = cut.groupBy("shard", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy(key, *order)) - 1
    numbered = cut.withColumn("place", place)
    return (
        numbered.join(starts, ["shard", "part"])
        .withColumn("slot", (F.col("first") + F.col("place")).cast("long"))
        .drop("part", "place", "first")
    )


def assign(docs: DataFrame, shards: int = SHARDS, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, grown_shard`` of every row.

    ``size`` is the text's UTF-8 bytes plus 16 and ``text_crc32`` their checksum; a null text has
    no bytes and checksum 0.  ``grown_shard`` is the shard among one more.  The key alone decides,
    so rows that repeat a key share its shard and get slots of their own.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(content) + 16).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
        jump_shard(F.col(key), shards).alias("shard"),
        jump_shard(F.col(key), shards + 1).alias("grown_shard"),
    )
    return with_slots(rows, "doc_id", ["text_crc32", "size"], parts)
