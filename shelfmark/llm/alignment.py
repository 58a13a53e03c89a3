"""Two tokenizers laid on each other: common token ends, overlapping tokens and how often they meet.

Both cut the same bytes.  The ends of their tokens are two ascending lists; an end that stands in both
closes a group, and the rank of an end in the other list says which tokens overlap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..scratch import pin
from .bytebpe import ByteTokens, blocks
from .common import keyed_text, text_bytes

SPACE = "▁"

# Texts are aligned together until they have about so many characters.
GROUP_CHARS = 1 << 20

# Needles that one lane of a search takes one after the other.
LANE = 64

# Rows that leave a task together at least, and links that are counted together.
_ROWS = 100
_LINKS = 1 << 20

# Up to this many linked id pairs (24 bytes each) the corpus counts go to every executor; beyond,
# the links are joined to them in a shuffle.
BROADCAST_PAIRS = 4_000_000


def gallop(needles: np.ndarray, haystack: np.ndarray, lane: int = LANE) -> np.ndarray:
    """For each needle, how many of the haystack are smaller; both ascend.

    The needles are cut into lanes that advance together.  A lane starts by binary search; from then
    on a search starts where the one before ended, doubles its stride until it is past the needle
    and halves it again.
    """
    count, size = len(needles), len(haystack)
    if not count or not size:
        return np.zeros(count, dtype=np.int64)
    lanes = -(-count // lane)
    wanted = np.append(needles, np.full(lanes * lane - count, needles[-1])).reshape(lanes, lane)
    guarded = np.append(haystack, max(needles[-1], haystack[-1]))
    at, out = np.searchsorted(haystack, wanted[:, 0]), np.empty((lanes, lane), dtype=np.int64)
    for step in range(lane):
        value = wanted[:, step]
        going = np.flatnonzero(guarded[at] < value)
        if len(going):
            v, low = value[going], at[going]
            stride, high = 1, np.minimum(low + 1, size)
            short = guarded[high] < v
            while short.any():
                stride *= 2
                low = np.where(short, high, low)
                high = np.where(short, np.minimum(high + stride, size), high)
                short = guarded[high] < v
            while (wide := high - low > 1).any():
                middle = (low + high) >> 1
                below = wide & (guarded[middle] < v)
                low, high = np.where(below, middle, low), np.where(wide & ~below, middle, high)
            at[going] = high
        out[:, step] = at
    return out.ravel()[:count]


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of overlapping tokens, and which tokens of either list close a group.

    Both lists ascend and have the same last end.  The shorter one is looked up in the longer.
    """
    swapped = len(ends_b) < len(ends_a)
    few, many = (ends_b, ends_a) if swapped else (ends_a, ends_b)
    rank = gallop(few, many)
    common = many[np.minimum(rank, len(many) - 1)] == few if len(few) else np.zeros(0, dtype=bool)
    closing = np.zeros(len(many), dtype=bool)
    closing[rank[common]] = True
    # A token overlaps those from the end behind its start to the first end not before its own.
    first = np.concatenate([[0], (rank + common)[:-1]]) if len(few) else rank
    spans = rank - first + 1
    own = np.repeat(np.arange(len(few)), spans)
    other = np.arange(len(own)) - np.repeat(np.cumsum(spans) - spans, spans) + np.repeat(first, spans)
    return (other, own, closing, common) if swapped else (own, other, common, closing)


class Pair:
    """Both tokenizers, with their ids as written in a text of groups."""

    def __init__(self, byte_path: str, piece_path: str):
        from sentencepiece import SentencePieceProcessor

        self.a = ByteTokens(byte_path, special=False)
        self.pieces = SentencePieceProcessor(model_file=piece_path)
        count = self.pieces.get_piece_size()
        named = [self.pieces.id_to_piece(k) for k in range(count)]
        plain = [not (self.pieces.is_byte(k) or self.pieces.is_control(k) or self.pieces.is_unknown(k)) for k in range(count)]
        if any(SPACE in p.lstrip(SPACE) for p, own in zip(named, plain) if own):
            raise ValueError("a piece crosses words; texts could not be cut into blocks")
        self.surface_b = [
            bytes([int(p[3:5], 16)]) if self.pieces.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(named)
        ]
        self.sizes_b = np.fromiter(map(len, self.surface_b), dtype=np.int64, count=count)
        self.base = max(count, len(self.a.surface))
        # An id as it is written inside a group, and as the last of its side.
        self.written = [
            str(k).encode() + mark
            for mark, size in ((b",", self.base), (b"|", self.base), (b",", self.base), (b";", self.base))
            for k in range(size)
        ]

    def encode(self, block: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a block that starts with a space by both; None where they do not spell its bytes."""
        data = block.encode()
        a = self.a.encode_block(block).astype(np.int64)
        # The pieces' model puts the first space in front by itself.
        b = np.array(self.pieces.encode(block[1:]), dtype=np.int64)
        for ids, surface in ((a, self.a.surface), (b, self.surface_b)):
            if b"".join(map(surface.__getitem__, ids.tolist())) != data:
                return None
        return a, b


@dataclass
class Found:
    """What is known of one document so far."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    digest: "hashlib._Hash" = field(default_factory=hashlib.sha256)
    last: bytes = b""
    keys: list[np.ndarray] = field(default_factory=list)
    times: list[np.ndarray] = field(default_factory=list)
    parts: list[bytes] = field(default_factory=list)
    good: bool = True

    def add(self, n_a: int, n_b: int, n_groups: int, n_links: int, groups: bytes, keys: np.ndarray, times: np.ndarray) -> None:
        self.n_a, self.n_b = self.n_a + n_a, self.n_b + n_b
        self.n_groups, self.n_links = self.n_groups + n_groups, self.n_links + n_links
        # The mark behind the last group of all is not part of the text.
        own, self.last = self.last + groups[:-1], groups[-1:]
        self.digest.update(own)
        self.parts.append(own)
        self.keys.append(keys)
        self.times.append(times)

    def row(self, base: int) -> tuple:
        if not self.good or not self.n_a:
            return 0, 0, 0, 0, "", *[np.zeros(0, np.int32)] * 3, ""
        keys, times = self.keys[0], self.times[0]
        if len(self.keys) > 1:
            keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
            times = np.bincount(at, weights=np.concatenate(self.times)).astype(np.int64)
        return (
            self.n_a, self.n_b, self.n_groups, self.n_links, self.digest.hexdigest(),
            (keys // base).astype(np.int32), (keys % base).astype(np.int32), times.astype(np.int32),
            b"".join(self.parts).decode(),
        )


def align(pair: Pair, coded: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple]:
    """For each of some blocks, its counts, its groups as text, and its distinct id pairs with their numbers."""
    if not coded:
        return
    base = pair.base
    a, b = (np.concatenate([c[side] for c in coded]) for side in (0, 1))
    edges = np.cumsum([[0, 0]] + [[len(x), len(y)] for x, y in coded], axis=0)
    # Ends count on from block to block, so that a block's last end is common to both.
    left, right, last_a, last_b = overlaps(np.cumsum(pair.a.sizes[a]), np.cumsum(pair.sizes_b[b]))
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    # Tokens as they are written: a group's of the first side, then those of the second.
    before_b = np.concatenate([[0], np.flatnonzero(last_b) + 1])[group_a]
    before_a = (np.flatnonzero(last_a) + 1)[group_b]
    codes = np.empty(len(a) + len(b), dtype=np.int64)
    codes[np.arange(len(a)) + before_b] = a + base * last_a
    codes[np.arange(len(b)) + before_a] = b + base * (2 + last_b)
    written = list(map(pair.written.__getitem__, codes.tolist()))
    block_of = np.repeat(np.arange(len(coded)), np.diff(edges[:, 0]))[left]
    keys, times = np.unique((block_of * base + a[left]) * base + b[right], return_counts=True)
    pieces = np.searchsorted(keys, np.arange(len(coded) + 1) * base * base)
    groups = np.concatenate([[0], np.cumsum(last_a)])[edges[:, 0]]
    links = np.searchsorted(block_of, np.arange(len(coded) + 1))
    for k in range(len(coded)):
        (a0, b0), (a1, b1) = edges[k], edges[k + 1]
        own = slice(pieces[k], pieces[k + 1])
        yield (
            int(a1 - a0), int(b1 - b0), int(groups[k + 1] - groups[k]), int(links[k + 1] - links[k]),
            b"".join(written[a0 + b0 : a1 + b1]), keys[own] - k * base * base, times[own],
        )


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<int>"


def aligned(
    docs: DataFrame, byte_path: str, piece_path: str, *, with_groups: bool = False, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Counts and digest of every text's groups, and its distinct linked id pairs ``a``, ``b`` with their ``times``.

    ``with_groups`` adds the groups themselves as text.  A text that is null or empty, or that
    either tokenizer does not spell byte for byte, has none.
    """
    schema = _ALIGNED + (", groups string" if with_groups else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(byte_path, piece_path)

        def rows_of(ids: list, found: list[Found]) -> pa.RecordBatch:
            counts, digests, lists, groups = (lambda c: (c[:4], c[4], c[5:8], c[8]))(list(zip(*[f.row(pair.base) for f in found])))
            arrays = [pa.array(ids, pa.int64()), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string())]
            arrays += [pa.array(c, pa.list_(pa.int32())) for c in lists]
            arrays += [pa.array(groups, pa.string())] if with_groups else []
            return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in schema.split(", ")])

        def settle(waiting: list[tuple[Found, tuple]]) -> None:
            for (found, _), told in zip(waiting, align(pair, [coded for _, coded in waiting])):
                found.add(*told)
                if not with_groups:
                    found.parts.clear()
            waiting.clear()

        for batch in batches:
            ids, all_found, waiting, size = [], [], [], 0
            for doc_id, value in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                found = Found()
                ids.append(doc_id)
                all_found.append(found)
                for block in blocks(" " + value.decode("utf-8", "replace")) if value else ():
                    coded = pair.encode(block)
                    if coded is None:
                        found.good = False
                        break
                    waiting.append((found, coded))
                    size += len(block)
                    if size >= GROUP_CHARS:
                        settle(waiting)
                        size = 0
                if len(ids) >= _ROWS and not waiting:
                    yield rows_of(ids, all_found)
                    ids, all_found = [], []
            settle(waiting)
            if ids:
                yield rows_of(ids, all_found)

    return keyed_text(docs, key, text).mapInArrow(run, schema)


def _parted(batch: pa.RecordBatch, lists: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about so many list elements (one long row is a part of its own)."""
    ends = np.cumsum(batch.column(lists).value_lengths().to_numpy())
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + _LINKS, side="right")))
        yield batch.slice(start, end - start)
        start = end


def pair_counts(found: DataFrame) -> DataFrame:
    """``a, b, n, best``: in how many documents an id pair is linked, and whether that is the most of its ``a``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in _parted(batch, 0)):
            a, b = (part.column(k).flatten().to_numpy().astype(np.int64) for k in (0, 1))
            keys, n = np.unique(a << 32 | b, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])

    # A pair has a partial count in each part; they are added where they are made, then once for each pair.
    summed = found.select("a", "b").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    summed = summed.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "n")
    # An id meets no more others than the second vocabulary has.
    return summed.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))


_TOLD = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"


def _weighed_here(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Sums over every row's links, with the counts in every task."""
    table = counts.select(F.shiftleft("a", 32).bitwiseOR(F.col("b")).alias("pair"), "n", "best").toArrow()
    order = np.argsort(table["pair"].to_numpy())
    arrays = [table[c].to_numpy()[order] for c in ("pair", "n", "best")]
    shared = found.sparkSession.sparkContext.broadcast(arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for part in (p for batch in batches for p in _parted(batch, len(_TOLD))):
            a, b, times = (part.column(len(_TOLD) + k).flatten().to_numpy().astype(np.int64) for k in range(3))
            at = np.searchsorted(pairs, a << 32 | b)
            edges = np.concatenate([[0], np.cumsum(part.column(len(_TOLD)).value_lengths().to_numpy())]).astype(np.int64)
            sums = []
            for value in (times * best[at], times * n[at]):
                upto = np.concatenate([[0], np.cumsum(value)])
                sums.append(pa.array(np.diff(upto[edges])))
            told = [part.column(k) for k in range(len(_TOLD))]
            yield pa.RecordBatch.from_arrays(told + sums, [*_TOLD, "n_best", "count_sum"])

    return found.select(*_TOLD, "a", "b", "times").mapInArrow(run, _OUT)


def _weighed_apart(found: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a join; a pair in most documents is cut by its row number, its count sent to each part."""
    parts = 16
    links = found.select("row", F.explode(F.arrays_zip("a", "b", "times")).alias("l")).select(
        "row", F.col("l.a").cast("long").alias("a"), F.col("l.b").cast("long").alias("b"), F.col("l.times").alias("times"),
        F.pmod("row", F.lit(parts)).alias("salt"),
    )
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    sums = links.join(salted, ["a", "b", "salt"]).groupBy(F.col("row").alias("_row")).agg(
        F.sum(F.col("times") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    none = F.lit(0).cast("long")
    return found.join(sums, F.col("row") == F.col("_row"), "left").select(
        *_TOLD, F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum")
    )


def align_documents(
    docs: DataFrame, byte_path: str, piece_path: str, *, key: str = "doc_id", text: str = "text",
    broadcast_pairs: int = BROADCAST_PAIRS,
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum`` of every row.

    ``n_links`` counts overlapping token occurrences; ``count_sum`` adds for each link the number of
    documents in which its id pair is linked, and ``n_best`` counts the links whose pair has the
    highest such number of its first id, ties included.  Null and empty texts, and those that a
    tokenizer does not spell byte for byte, have zeros and an empty digest.  Rows that repeat are
    documents each; other columns take no part.  The number of distinct pairs decides between two
    plans with equal results.
    """
    found = aligned(docs, byte_path, piece_path, key=key, text=text)
    found = pin(found.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = pin(pair_counts(found), "pairs")
    small = counts.count() <= broadcast_pairs
    return (_weighed_here if small else _weighed_apart)(found, counts)
