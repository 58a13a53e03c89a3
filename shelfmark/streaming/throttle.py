"""At most one accepted event per key and interval."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import TimestampNTZType

from ..constants import THROTTLE_SECONDS
from ..scratch import pin


def _micros(events: DataFrame, at: str) -> Column:
    """Microseconds since 1970; a time stamp without a zone is read as it stands."""
    if isinstance(events.schema[at].dataType, TimestampNTZType):
        epoch = F.lit("1970-01-01").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, F.col(at))
    return F.unix_micros(at)


class _Throttle(StatefulProcessor):
    """Keeps the time of the last accepted event per key."""

    def __init__(self, interval_us: int) -> None:
        self._interval = interval_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        # Only distinct times are held while a batch's rows for one key are put in order.
        times: set[int] = set()
        for chunk in rows:
            times.update(chunk["at_us"].tolist())
        held = self._last.get()
        last = held[0] if held is not None else None
        accepted = []
        for at in sorted(times):
            if last is None or at - last >= self._interval:
                accepted.append(at)
                last = at
        if accepted:
            self._last.update((last,))
            yield pd.DataFrame({"key": [key[0]] * len(accepted), "at_us": accepted})

    def close(self) -> None:
        pass


def throttle_stream(events: DataFrame, key: str, at: str, seconds: int = THROTTLE_SECONDS) -> DataFrame:
    """Stateful stream of accepted (key, at_us); needs the RocksDB state store."""
    key_type = events.schema[key].dataType.simpleString()
    micros = events.select(F.col(key).alias("key"), _micros(events, at).alias("at_us"))
    return micros.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Throttle(seconds * 1_000_000),
        outputStructType=f"key {key_type}, at_us bigint",
        outputMode="Append",
        timeMode="None",
    )


def throttle_batch(
    events: DataFrame, key: str, at: str, seconds: int = THROTTLE_SECONDS
) -> DataFrame:
    """Accepted (key, at_us) of a whole table, with no task walking a key's full history.

    Every event knows its successor: the first event at least one interval later, found inside
    the next interval-sized bucket or at the head of a later one.  The accepted chain is what the
    first event reaches; each round doubles the jump, so rounds grow with the logarithm of the
    chain's length.
    """
    step = seconds * 1_000_000
    times = (
        events.select(F.col(key).alias("key"), _micros(events, at).alias("at_us"))
        .filter("at_us IS NOT NULL AND key IS NOT NULL")
        .distinct()
        .withColumn("_b", F.floor(F.col("at_us") / step))
    )
    times = pin(times, "throttle")
    # First event of the first non-empty bucket at least two ahead.
    heads = times.groupBy("key", "_b").agg(F.min("at_us").alias("_head"))
    ahead = Window.partitionBy("key").orderBy("_b").rangeBetween(2, Window.unboundedFollowing)
    later = heads.select("key", "_b", F.min("_head").over(ahead).alias("_later"))
    # Probes look for the earliest event of the next bucket that is an interval away.
    probes = times.select("key", (F.col("_b") + 1).alias("_b"), "at_us", (F.col("at_us") + step).alias("_need"), F.lit(1).alias("_probe"))
    targets = times.select("key", "_b", "at_us", F.col("at_us").alias("_need"), F.lit(0).alias("_probe"))
    after = (
        Window.partitionBy("key", "_b").orderBy(F.col("_need").desc(), F.col("_probe"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    near = (
        probes.unionByName(targets)
        .withColumn("_near", F.min(F.when(F.col("_probe") == 0, F.col("at_us"))).over(after))
        .filter("_probe = 1")
        .select("key", (F.col("_b") - 1).alias("_b"), "at_us", "_near")
    )
    jump = pin(
        near.join(later, ["key", "_b"])
        .select("key", "at_us", F.coalesce("_near", "_later").alias("_to"))
        .filter("_to IS NOT NULL"),
        "jump",
    )
    reached = times.groupBy("key").agg(F.min("at_us").alias("at_us"))
    size = reached.count()
    while True:
        hop = reached.join(jump, ["key", "at_us"]).select("key", F.col("_to").alias("at_us"))
        reached = pin(reached.unionByName(hop).distinct(), "reached")
        grown = reached.count()
        if grown == size:
            return reached
        size = grown
        far = jump.select("key", F.col("at_us").alias("_to"), F.col("_to").alias("_far"))
        jump = pin(
            jump.join(far, ["key", "_to"]).select("key", "at_us", F.col("_far").alias("_to")), "jump"
        )
