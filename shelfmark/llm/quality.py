"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from .common import keyed_text, sliced

BUCKETS = 1 << 18

# Rows that training reads at most: those with the smallest hash of their key.
SAMPLE_ROWS = 6_000
PASSES = 3

# Learning rate and its offset, L1 and L2 weight of the leader's objective.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4

# A text's feature values sum to this over its n-grams, whatever its length.
TEXT_WEIGHT = 20.0

_BASE = np.uint64(0x9E3779B97F4A7C15)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
_REPEAT = np.uint64(0x5EA1)


def _byte_kinds() -> np.ndarray:
    """0 for white space, 1 for letters and digits (every byte above ASCII too), 2 for other signs."""
    kinds = np.full(256, 2, dtype=np.uint8)
    kinds[[c for c in range(128) if chr(c).isalnum()]] = 1
    kinds[128:] = 1
    kinds[[9, 10, 11, 12, 13, 32]] = 0
    return kinds


_KINDS = _byte_kinds()
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


def features(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all word 1-grams and 2-grams, and the number of the text each is from.

    A word is a run of letters and digits or a run of other signs, in lower case.  A word that
    repeats one of the two before it counts as one and the same word "repeat".
    """
    # A zero byte between texts ends the last word of each.
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    kind = _KINDS[data]
    edge = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    ends = np.append(edge[1:], len(data))
    word = kind[edge] > 0
    start, end = edge[word], ends[word]
    if not len(start):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    # Each letter's value depends on its place in the word only, so a sum is a hash of the word.
    place = np.arange(len(data)) - np.repeat(edge, ends - edge)
    letter = _mixed((_LOWER[data].astype(np.uint64) + np.uint64(1)) * _BASE + place.astype(np.uint64))
    hashes = _mixed(np.add.reduceat(np.where(kind > 0, letter, 0), edge)[word])
    same = np.concatenate([[False], owner[1:] == owner[:-1]])
    same_two = np.concatenate([[False] * 2, owner[2:] == owner[:-2]])[: len(owner)]
    again = (same & (hashes == np.roll(hashes, 1))) | (same_two & (hashes == np.roll(hashes, 2)))
    hashes = np.where(again, _REPEAT, hashes)
    pairs = _mixed(np.roll(hashes, 1) * _PAIR + hashes)[same]
    bucket = np.concatenate([hashes, pairs]) & np.uint64(buckets - 1)
    return bucket.astype(np.int64), np.concatenate([owner, owner[same]])


class Leader:
    """Per-coordinate follow-the-regularised-leader for logistic loss; the last weight is the bias."""

    def __init__(self, buckets: int = BUCKETS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(buckets + 1), np.zeros(buckets + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        rate = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / rate)

    def update(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        weights = self.weights(at)
        gradient = (1 / (1 + np.exp(-np.clip(weights @ values, -30, 30))) - label) * values
        step = (np.sqrt(self.n[at] + gradient**2) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += gradient - step * weights
        self.n[at] += gradient**2


def train(rows: list[tuple[int, np.ndarray]], buckets: int = BUCKETS, passes: int = PASSES) -> np.ndarray:
    """Weights (bias last) from ``(label, buckets of the n-grams)`` rows, in the order given."""
    leader = Leader(buckets)
    examples = []
    for label, grams in rows:
        at, counts = np.unique(np.asarray(grams, dtype=np.int64), return_counts=True)
        values = np.append(counts * (TEXT_WEIGHT / max(1, len(grams))), 1.0)
        examples.append((np.append(at, buckets), values, label))
    for _ in range(passes):
        for at, values, label in examples:
            leader.update(at, values, label)
    return leader.weights(slice(None))


def _featurise(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_pylist()
            for keys, texts in sliced(batch):
                own, labels = labels[: len(keys)], labels[len(keys) :]
                bucket, owner = features(texts, buckets)
                order = np.argsort(owner, kind="stable")
                edges = np.searchsorted(owner[order], np.arange(1, len(texts)))
                grams = np.split(bucket[order].astype(np.int32), edges)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(own, pa.int32()), pa.array(grams, pa.list_(pa.int32()))],
                    ["doc_id", "label", "grams"],
                )

    return run


def fit(docs: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS, sample_rows: int = SAMPLE_ROWS, passes: int = PASSES) -> np.ndarray:
    """Weights learned from ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, label`` 0 or 1).

    At most ``sample_rows`` labels are used, those whose key has the smallest hash; a key with
    several labels or texts gives as many examples.  The order of training is that of the hash.
    """
    known = labels.filter("doc_id IS NOT NULL AND label IN (0, 1)").select(
        "doc_id", F.col("label").cast("int").alias("label"), F.xxhash64("doc_id").alias("place")
    )
    sample = known.orderBy("place", "doc_id", "label").limit(sample_rows)
    # The sample is bounded by its limit, so it may go to every executor.
    rows = keyed_text(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")
    found = rows.mapInArrow(_featurise(buckets), "doc_id long, label int, grams array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            grams = batch.column("grams")
            edges = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(grams).to_numpy())])
            lists = np.split(grams.flatten().to_numpy(), edges[1:-1])
            examples += zip(batch.column("label").to_pylist(), lists)
        weights = train(examples, buckets, passes).astype("<f4")
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], ["weights"])

    # One task learns; what reaches it is bounded by the sample.
    ordered = found.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "label", "grams")
    row = ordered.mapInArrow(run, "weights binary").first()
    return np.frombuffer(bytes(row.weights), dtype="<f4") if row else np.zeros(buckets + 1, dtype="<f4")


def score(docs: DataFrame, weights: np.ndarray, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` of every whole text: the chance of label 1; a text without words has the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.astype(np.float64)
        for batch in batches:
            for keys, texts in sliced(batch):
                bucket, owner = features(texts, len(own) - 1)
                count = np.bincount(owner, minlength=len(texts))
                total = np.bincount(owner, weights=own[bucket], minlength=len(texts))
                logit = total * TEXT_WEIGHT / np.maximum(1, count) + own[-1]
                value = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(value)], ["doc_id", "score"])

    return keyed_text(docs, key, text).mapInArrow(run, "doc_id long, score double")
