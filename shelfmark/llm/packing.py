"""Documents packed into sequences of one length, by best fit into a bounded number of open windows."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import pin
from .bytebpe import ByteTokens
from .common import keyed_text, text_bytes

LENGTH = 1024
END_ID = 0

# Windows that a partition keeps open.
OPEN_WINDOWS = 64

# Pieces leave a task in batches of about so many ids.
_BATCH_IDS = 1 << 18

Piece = tuple[int | None, int, np.ndarray, int]  # doc_id, start, ids, ids of the document


class Windows:
    """The open windows of one partition.

    A piece goes into the window with the least room that holds it.  If none does and no further
    window may be opened, the fullest is filled up with the head of the piece and leaves; the rest
    of the piece is placed again.
    """

    def __init__(self, length: int = LENGTH, open_windows: int = OPEN_WINDOWS):
        self.length, self.open_windows = length, max(1, open_windows)
        self.rooms: list[tuple[int, int]] = []  # room left and number, least room first
        self.held: dict[int, list[Piece]] = {}
        self.opened = 0

    def _open(self) -> None:
        insort(self.rooms, (self.length, self.opened))
        self.held[self.opened] = []
        self.opened += 1

    def place(self, piece: Piece) -> Iterator[list[Piece]]:
        """Add a piece; windows that it fills leave."""
        while len(piece[2]):
            doc_id, start, ids, total = piece
            if len(ids) >= self.length:
                # A whole window of its own.
                yield [(doc_id, start, ids[: self.length], total)]
                piece = (doc_id, start + self.length, ids[self.length :], total)
                continue
            at = bisect_left(self.rooms, (len(ids), -1))
            if at == len(self.rooms) and at < self.open_windows:
                self._open()
                at = bisect_left(self.rooms, (len(ids), -1))
            at = 0 if at == len(self.rooms) else at
            room, number = self.rooms.pop(at)
            head = min(room, len(ids))
            self.held[number].append((doc_id, start, ids[:head], total))
            if room == head:
                yield self.held.pop(number)
            else:
                insort(self.rooms, (room - head, number))
            piece = (doc_id, start + head, ids[head:], total)

    def left(self) -> list[list[Piece]]:
        """The windows still open, in the order of their opening."""
        return [self.held[number] for number in sorted(self.held)]


_COLUMNS = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
    ("part", pa.int32()), ("window", pa.int64()), ("offset", pa.int64()),
])
_DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, part int, window long, offset long"


def _place(tokenizer_path: str, length: int, end_id: int, open_windows: int):
    """Pieces of a partition: those of filled windows, then what is left, one behind the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tokens = TaskContext.get().partitionId(), ByteTokens(tokenizer_path)
        windows, end = Windows(length, open_windows), np.array([end_id], dtype=np.uint32)
        rows: list[tuple] = []
        held = filled = 0

        def add(pieces: list[Piece], window: int | None, offset: int) -> int:
            for doc_id, start, ids, total in pieces:
                data = ids.astype("<u4").tobytes()
                rows.append((doc_id, start, len(ids), data, total, part, window, offset))
                offset += len(ids)
            return offset

        def batch_of() -> pa.RecordBatch:
            arrays = [pa.array(c, f.type) for c, f in zip(zip(*rows), _COLUMNS)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=_COLUMNS)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                ids = np.append(tokens.encode(text.decode("utf-8", "replace")), end)
                for pieces in windows.place((doc_id, 0, ids, len(ids))):
                    held += add(pieces, filled, 0)
                    filled += 1
                    if held >= _BATCH_IDS:
                        yield batch_of()
                        held = 0
        offset = 0
        for pieces in windows.left():
            offset = add(pieces, None, offset)
        if rows:
            yield batch_of()

    return run


def _tail_cuts(total: int, length: int) -> list[int]:
    """Where the last ids, too few for a window, are cut: into powers of two, largest first."""
    at = total // length * length
    cuts = [at]
    while at < total:
        at += 1 << ((total - at).bit_length() - 1)
        cuts.append(at)
    return cuts


def pack(
    docs: DataFrame, tokenizer_path: str, *, length: int = LENGTH, end_id: int = END_ID,
    open_windows: int = OPEN_WINDOWS, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset`` of every piece of every document.

    A document is its token ids and ``end_id``; ``ids`` are 32-bit little-endian.  Every id is in
    exactly one piece, and ``start`` counts the ids of its document in front of it.  A partition
    fills windows of ``length`` ids, of which it keeps ``open_windows`` open.  The windows left open
    by all partitions are then laid end to end and cut into windows again, by offsets that one
    number a partition gives; the last ids of all, too few for a window, become sequences of a
    power of two each.  So a sequence has ``length`` ids, or a power of two, and needs no padding.

    ``sequence_id`` has no gaps.  A null or empty text is the end id alone; rows that repeat are
    packed each for itself; an empty table has no sequence.  Other columns take no part.
    """
    placed = keyed_text(docs, key, text).mapInArrow(_place(tokenizer_path, length, end_id, open_windows), _DDL)
    placed = pin(placed, "placed")
    # One row a task.
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part").agg(
        F.coalesce(F.max("window") + 1, F.lit(0)).alias("windows"),
        F.coalesce(F.sum(F.when(F.col("window").isNull(), F.col("length"))), F.lit(0)).alias("open_ids"),
    )
    whole = parts.agg(F.sum("windows").alias("windows"), F.sum("open_ids").alias("open_ids")).first()
    windows, open_ids = whole.windows or 0, whole.open_ids or 0
    before = parts.select(
        F.col("part").alias("_part"),
        *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_{c}") for c in ("windows", "open_ids")],
    )
    pieces = placed.join(F.broadcast(before), F.col("part") == F.col("_part"))
    own = ["doc_id", "start", "length", "ids", "doc_tokens"]
    closed = pieces.filter(F.col("window").isNotNull()).select(
        *own, (F.col("_windows") + F.col("window")).alias("sequence_id"), "offset"
    )
    laid = pieces.filter(F.col("window").isNull()).select(*own, (F.col("_open_ids") + F.col("offset")).alias("at"))
    return closed.union(_merged(laid, open_ids, windows, length))


def _merged(laid: DataFrame, total: int, first: int, length: int) -> DataFrame:
    """Pieces that lie end to end, cut wherever a window or one of the last sequences ends."""
    tail = _tail_cuts(total, length)
    full = F.lit(tail[0])
    end = F.col("at") + F.col("length")
    inner = F.filter(
        F.sequence(F.floor(F.col("at") / length) * length, end, F.lit(length).cast("long")),
        lambda c: (c > F.col("at")) & (c < end) & (c <= full),
    )
    last = F.filter(F.array(*[F.lit(c).cast("long") for c in tail[1:]]).cast("array<bigint>"), lambda c: (c > F.col("at")) & (c < end))
    edges = F.concat(F.array(F.col("at")), inner, last, F.array(end))
    cut = F.transform(
        F.sequence(F.lit(1), F.size(edges) - 1),
        lambda k: F.struct(F.get(edges, k - 1).alias("a"), F.get(edges, k).alias("b")),
    )
    rows = laid.withColumn("cut", F.explode(cut)).withColumns({"a": F.col("cut.a"), "b": F.col("cut.b")})
    skip = F.col("a") - F.col("at")

    def tail_value(of: list[int]) -> Column:
        out = F.lit(of[0]).cast("long")
        for c, value in list(zip(tail, of))[1:]:
            out = F.when(F.col("a") >= c, F.lit(value).cast("long")).otherwise(out)
        return out

    in_tail = F.col("a") >= full
    begin = F.when(in_tail, tail_value(tail)).otherwise(F.floor(F.col("a") / length) * length)
    number = F.when(in_tail, tail_value([tail[0] // length + k for k in range(len(tail))])).otherwise(F.floor(F.col("a") / length))
    return rows.select(
        "doc_id", (F.col("start") + skip).alias("start"), (F.col("b") - F.col("a")).alias("length"),
        F.substring("ids", (skip * 4 + 1).cast("int"), ((F.col("b") - F.col("a")) * 4).cast("int")).alias("ids"),
        "doc_tokens", (number + first).alias("sequence_id"), (F.col("a") - begin).alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids, doc_ids, starts``: each sequence whole, with where its documents begin in it."""
    piece = F.struct("offset", "ids", "doc_id")
    rows = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(piece)).alias("pieces")
    )
    ids = F.aggregate("pieces", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p.ids))
    return rows.select("sequence_id", "n_tokens", ids.alias("ids"), F.col("pieces.doc_id").alias("doc_ids"), F.col("pieces.offset").alias("starts"))
