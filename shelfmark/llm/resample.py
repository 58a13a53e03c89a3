"""Importance resampling: a draw of documents that look like a target, by weights over hashed n-grams.

Every document gets the mean gain of its features (how much likelier their buckets are in the target
than in the corpus) plus Gumbel noise that its id decides; the highest scores are a weighted draw
without replacement.  The lowest score that still wins is found exactly, without sorting the corpus,
by weighted medians of partition medians.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordering import ordered_prefix
from ..scratch import pin
from .common import keyed_text, text_bytes

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024

# Words are cut and hashed this many bytes of a text at a time.
BLOCK_BYTES = 1 << 20

# Distinct features whose bucket a task remembers; beyond that it starts over.
REMEMBERED = 500_000

# ASCII letters in lower case; every ASCII character that is neither letter nor digit is a space.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def word_blocks(text: bytes, size: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, some ``size`` bytes at a time, each block up to the end of a word."""
    start = 0
    while start < len(text):
        gap = _GAP.search(text, start + size)
        end = gap.start() if gap else len(text)
        yield text[start:end].translate(_FOLD).split()
        start = end


class Features:
    """Buckets of a text's runs of 1 to ``longest`` words."""

    def __init__(self, buckets: int, longest: int, remembered: int = REMEMBERED):
        self.buckets, self.longest, self.remembered = buckets, longest, remembered
        self.known: dict[bytes, int] = {}

    def _buckets(self, features: list[bytes]) -> np.ndarray:
        new = set(features).difference(self.known)
        if len(self.known) + len(new) > self.remembered:
            self.known.clear()
            new = set(features)
        crc, buckets = zlib.crc32, self.buckets
        self.known.update([(f, crc(f) % buckets) for f in new])
        return np.fromiter(map(self.known.__getitem__, features), dtype=np.int64, count=len(features))

    def of(self, text: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """Words and feature buckets of each block of a text."""
        tail: list[bytes] = []
        for own in word_blocks(text):
            words, fresh = tail + own, len(tail)
            runs = list(own)
            for n in range(2, self.longest + 1):
                # Runs that end in this block; those that ended before are counted.
                runs += [b" ".join(words[k : k + n]) for k in range(max(0, fresh - n + 1), len(words) - n + 1)]
            tail = words[len(words) - self.longest + 1 :] if self.longest > 1 else []
            yield len(own), self._buckets(runs)


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall into each bucket: one partial row a task and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, held = Features(buckets, longest), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for value in text_bytes(batch.column(0)):
                for _, found in features.of(value):
                    held += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["bucket", "n"])

    parts = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    # At most one row for each bucket reaches the driver.
    out = np.zeros(buckets, dtype=np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths of a nat, add-one smoothed, rounded down."""
    count = len(source)
    all_source, all_target = float(source.sum()) + count, float(target.sum()) + count
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * all_source / ((s + 1.0) * all_target))) for s, t in zip(source.tolist(), target.tolist())],
        dtype=np.int64,
    )


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from the document's id alone (a null id counts as no digits)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return math.floor(-1000 * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))


def scores(
    docs: DataFrame, gain: np.ndarray, *, longest: int = LONGEST, seed: int = SEED, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, gain = Features(len(shared.value), longest), shared.value
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                words = count = total = 0
                for own, found in features.of(value):
                    words, count, total = words + own, count + len(found), total + int(gain[found].sum())
                weight = total // count if count else 0
                rows.append((words, count, weight, weight + noise(doc_id, seed)))
            columns = np.array(rows, dtype=np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c) for c in columns]],
                ["doc_id", "n_words", "n_features", "weight", "score"],
            )

    return keyed_text(docs, key, text).mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long, score long"
    )


# The order of the draw, best first.  No two rows share a key: ``tie`` numbers them.
_KEY = ["high", "none", "doc_id", "n_features", "tie"]
_ZERO = np.zeros((0, len(_KEY)), dtype=np.int64)


def _keyed(scored: DataFrame) -> list[Column]:
    return [
        (-F.col("score")).alias("high"), F.col("doc_id").isNull().cast("long").alias("none"),
        F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), "n_features", "tie",
    ]


def _before(pivot: tuple[int, ...], strictly: bool) -> Column:
    """Whether a row of the key columns stands before the pivot."""
    out = F.lit(not strictly)
    for name, value in reversed(list(zip(_KEY, pivot))):
        own = F.col(name)
        out = (own < value) | ((own == value) & out)
    return out


def _sorted(keys: np.ndarray) -> np.ndarray:
    return keys[np.lexsort(keys.T[::-1])]


def _sides(low, high, pivot):
    """For each partition: how many remaining keys stand before and behind the pivot, and both medians."""

    def less(keys: np.ndarray, than: tuple[int, ...]) -> np.ndarray:
        out = np.zeros(len(keys), dtype=bool)
        for column, value in reversed(list(zip(keys.T, than))):
            out = (column < value) | ((column == value) & out)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_ZERO]
        for batch in batches:
            keys = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            if low:
                keys = keys[~less(keys, low) & (keys != low).any(axis=1)]
            if high:
                keys = keys[less(keys, high)]
            parts.append(keys)
        keys = _sorted(np.concatenate(parts))
        first = int(less(keys, pivot).sum()) if pivot else len(keys)
        rest = keys[first:]
        if pivot and len(rest) and tuple(rest[0]) == pivot:
            rest = rest[1:]
        for behind, side in ((False, keys[:first]), (True, rest)):
            if len(side):
                row = [behind, len(side), *side[(len(side) - 1) // 2].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["behind", "n", *_KEY])

    return run


def cutoff(keys: DataFrame, wanted: int) -> tuple[int, ...] | None:
    """The key in place ``wanted`` (from one) of a pinned table of distinct keys ``_KEY``; None for none.

    Every round is one job.  Each partition tells the median of its remaining keys and their number;
    the median of the medians, each weighted by its partition's remaining keys, has at least a
    quarter of all remaining keys on either side, so a quarter goes in every round, whatever the
    data look like.  One row a partition and side comes to the driver; a task holds the remaining
    keys of its partition.
    """
    if wanted < 1:
        return None
    low = high = pivot = None
    passed = 0
    schema = "behind boolean, n long, " + ", ".join(f"{k} long" for k in _KEY)
    while True:
        left = keys
        # What is decided by the first column alone does not leave Spark.
        if low:
            left = left.filter(F.col("high") >= low[0])
        if high:
            left = left.filter(F.col("high") <= high[0])
        found = left.mapInArrow(_sides(low, high, pivot), schema).collect()
        ahead = sum(r.n for r in found if not r.behind)
        if pivot and passed + ahead + 1 == wanted:
            return pivot
        behind = pivot is not None and passed + ahead < wanted
        if behind:
            low, passed = pivot, passed + ahead + 1
        elif pivot:
            high = pivot
        side = sorted((tuple(r[2:]), r.n) for r in found if r.behind == behind)
        if not side:
            return None
        half, seen = sum(n for _, n in side) / 2, 0
        for pivot, n in side:
            seen += n
            if seen >= half:
                break


def resample(
    docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, key: str = "doc_id", text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row; ``rank`` numbers those that are drawn.

    Drawn are ``percent`` of the texts with ``least_words`` words or more, rounded down, by highest
    score; ties go to the smaller ``doc_id`` (a null one last), then to fewer features.  Null and
    empty texts have no features and weight 0.  Rows that repeat are drawn each for itself; other
    columns of either table take no part.  An empty target or corpus gives every bucket its
    smoothed gain.
    """
    gain = gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, target_text, buckets, longest))
    scored = scores(docs, gain, longest=longest, seed=seed, key=key, text=text)
    scored = pin(scored.withColumn("tie", F.monotonically_increasing_id()), "scored")
    able = scored.filter(F.col("n_words") >= least_words)
    wanted = percent * able.count() // 100
    keys = able.select(*_keyed(scored))
    last = cutoff(keys, wanted)
    if last is None:
        return scored.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    marked = scored.select(
        F.struct("doc_id", "n_features", "weight", "score").alias("own"), "n_words", *_keyed(scored)
    ).withColumn("won", (F.col("n_words") >= least_words) & _before(last, strictly=False))
    winners = ordered_prefix(marked.filter("won").select("own", *_KEY), [], [F.col(k) for k in _KEY], number="rank")
    rest = marked.filter("NOT won").select("own.*", F.lit(None).cast("long").alias("rank"))
    return winners.select("own.*", "rank").union(rest)
