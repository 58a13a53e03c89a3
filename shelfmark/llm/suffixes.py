"""Removal of repeated byte strings, decided on a hash-compared order of suffixes.

Sorting every suffix of the corpus would move each text a hundred times over.  Instead every
window of ``length`` bytes is owned by its *anchor*: the k-gram inside it with the smallest hash.
Equal windows have equal anchors at the same offset, so only suffixes that begin at anchors seen
in two different surroundings have to be put in order:

1. Anchors.  Each document yields one row for each run of windows with one anchor: a hash of the
   anchor and one of the whole run.  A run that occurred before is covered as a whole.
2. Units.  Runs whose anchor also occurs with another surrounding are cut out of their texts.
3. Order.  The suffixes of an anchor's units are merge-sorted.  A comparison finds the common
   extension of two suffixes by binary search over prefix polynomial hashes; neighbours in the
   order then say which windows have a right part in common, prefix hashes which of these
   have the left part too, and the bytes themselves confirm every match.

Each step drops what its own task has already seen before anything is shuffled, so a passage
that a third of all documents share arrives once a task, not once a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import carried, carried_type, text_bytes

LENGTH = 100
GRAM = 32

# An anchor with more surroundings than this is cut into units of a few windows each, keyed by
# the bytes these windows have in common, so that no key gathers all of a common passage.
HOT_RUNS = 256
CUT_WINDOWS = 8

_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 20  # windows anchored at a time
_PLACE = (1 << 24) - 1
_FLUSH = 400_000  # anchors compared inside a task before they are sent on
_SLAB = 1 << 20  # bytes of units put in order at a time
_ROWS = 1 << 13  # rows handed to Spark at a time


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class PrefixHashes:
    """Polynomial hashes (modulo 2**64) of every prefix, hence of every substring in O(1)."""

    _up = _powers(_BASE, 1)
    _down = _powers(_UNBASE, 1)

    def __init__(self, text: np.ndarray):
        cls, size = type(self), len(text) + 1
        if len(cls._up) < size:
            room = max(size, _BLOCK)
            cls._up, cls._down = _powers(_BASE, room), _powers(_UNBASE, room)
        self.sums = np.zeros(size, dtype=np.uint64)
        terms = self.sums[1:]
        np.add(text, np.uint64(1), out=terms, casting="unsafe")
        terms *= cls._up[: size - 1]
        np.cumsum(terms, out=terms)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * type(self)._down[start]

    def all_of(self, width: int) -> np.ndarray:
        count = len(self.sums) - width
        return (self.sums[width:] - self.sums[:count]) * type(self)._down[:count]


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(29))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchor_runs(text: bytes, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``(hash, first window, last window, anchor)`` of each run of windows with one anchor.

    Long texts are taken in blocks of windows; a run that crosses a block border is two runs.
    """
    data = np.frombuffer(text, dtype=np.uint8)
    for at in range(0, len(data) - length + 1, _BLOCK):
        part = data[at : at + _BLOCK + length - 1]
        grams = _mixed(PrefixHashes(part).all_of(gram))
        place = np.arange(len(grams), dtype=np.uint64)
        ranked = (grams & ~np.uint64(_PLACE)) | place
        owner = (_sliding_least(ranked, length - gram + 1) & np.uint64(_PLACE)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        last = np.append(first[1:], len(owner)) - 1
        yield grams[owner[first]], first + at, last + at, owner[first] + at


# A run of windows is told by its first window and its shape: which copy of the document it is in
# (see ``numbered``), how many windows follow the first, how far behind it the anchor is.  A
# negative shape marks bytes already known to go.
_SHAPE = 1 << 12

_RUNS = pa.schema([(n, pa.int64()) for n in ("key", "run", "doc", "lo", "shape")])
_UNITS = pa.schema(
    [(n, pa.int64()) for n in ("key", "doc", "copy", "lo", "hi", "at")] + [("data", pa.binary())]
)
_SPANS = pa.schema([(n, pa.int64()) for n in ("doc", "copy", "lo", "hi")])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _spread(doc: np.ndarray) -> np.ndarray:
    """Keys that deal rows which need no partner out evenly."""
    return _mixed(doc.view(np.uint64)).view(np.int64)


def _merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans as maximal runs (touching spans join)."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    cut = np.flatnonzero(np.concatenate([[True], lo[1:] > reach[:-1]]))
    return lo[cut], reach[np.append(cut[1:], len(lo)) - 1]


def _lists(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row borders and the fields of a column of struct lists; a null list is empty."""
    sizes = np.array([n or 0 for n in pa.compute.list_value_length(column).to_pylist()], dtype=np.int64)
    values = column.flatten()
    fields = {f.name: values.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(values.type)}
    return np.concatenate([[0], np.cumsum(sizes)]), fields


def _sliced_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, _ROWS):
        yield batch.slice(at, _ROWS)


def _find_runs(length: int, gram: int) -> Callable:
    def flush(parts: list[tuple]) -> pa.RecordBatch:
        key, run, doc, lo, shape = (np.concatenate(p) for p in zip(*parts))
        # The task's earliest row of each (anchor, run) stays, its other ones are covered.
        order = np.lexsort((lo, shape // (_SHAPE * _SHAPE), doc, run, key))
        k, r = key[order], run[order]
        gone = np.zeros(len(order), dtype=bool)
        gone[order[1:]] = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
        key = np.where(gone, _spread(doc), key.view(np.int64))
        columns = [key, run.view(np.int64), doc, lo, np.where(gone, ~shape, shape)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        parts, held = [], 0
        for batch in batches:
            docs, copies = batch.column("doc").to_numpy(), batch.column("copy").to_numpy()
            for doc, copy, text in zip(docs, copies, text_bytes(batch.column("text"))):
                for key, lo, hi, at in anchor_runs(text, length, gram):
                    runs = [digest(text[a : b + length]) for a, b in zip(lo.tolist(), hi.tolist())]
                    shape = (int(copy) * _SHAPE + (hi - lo)) * _SHAPE + (at - lo)
                    parts.append((key, np.array(runs, dtype=np.uint64), np.full(len(lo), doc), lo, shape))
                    held += len(lo)
                if held >= _FLUSH:
                    yield from _sliced_rows(flush(parts))
                    parts, held = [], 0
        if parts:
            yield from _sliced_rows(flush(parts))

    return run


def _cut_units(text: bytes, key: int, lo: int, hi: int, at: int, hot: bool, length: int) -> Iterator[tuple]:
    """``(key, lo, hi, at, bytes)`` of each unit: the whole run, or pieces of it if its anchor is hot."""
    if not hot:
        yield key, lo, hi, at, text[lo : hi + length]
        return
    for step in range((at - hi) // CUT_WINDOWS, (at - lo) // CUT_WINDOWS + 1):
        near, far = step * CUT_WINDOWS, step * CUT_WINDOWS + CUT_WINDOWS - 1
        core = text[max(0, at - near) : at - far + length]
        a, b = max(lo, at - far), min(hi, at - near)
        own = xxhash.xxh3_64_intdigest(core, (key + step) & (2**64 - 1)) - (1 << 63)
        yield own, a, b, at, text[a : b + length]


def _find_units(length: int) -> Callable:
    def covered(doc: int, copy: int, lo: int, hi: int) -> tuple:
        return int(_spread(np.array([doc]))[0]), doc, copy, lo, hi, None, None

    def flush(units: list[tuple]) -> pa.RecordBatch:
        """Units with the bytes of an earlier one of this task are covered."""
        units.sort(key=lambda u: (u[0], u[6], u[1:4]))
        out, last = [], None
        for unit in units:
            again = (unit[0], unit[6]) == last
            last = (unit[0], unit[6])
            out.append(covered(*unit[1:4], unit[4] + length) if again else unit)
        return batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * len(_UNITS)
        arrays = [pa.array(list(c), f.type) for c, f in zip(columns, _UNITS)]
        return pa.RecordBatch.from_arrays(arrays, schema=_UNITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, held = [], 0
        for batch in batches:
            spans = []
            docs, copies = batch.column("doc").to_pylist(), batch.column("copy").to_pylist()
            edges, found = _lists(batch.column("found"))
            span, back = found["shape"] // _SHAPE % _SHAPE, found["shape"] % _SHAPE
            for k, text in enumerate(text_bytes(batch.column("text"))):
                rows = np.arange(edges[k], edges[k + 1])
                gone = rows[found["gone"][rows]]
                lo, hi = found["lo"][gone], found["lo"][gone] + span[gone] + length
                for a, b in zip(*(x.tolist() for x in _merged(lo, hi))):
                    spans.append(covered(docs[k], copies[k], a, b))
                for row in rows[~found["gone"][rows]].tolist():
                    first = int(found["lo"][row])
                    place = first, first + int(span[row]), first + int(back[row])
                    for unit in _cut_units(text, int(found["key"][row]), *place, found["hot"][row], length):
                        units.append((unit[0], docs[k], copies[k], *unit[1:]))
                        held += len(unit[4])
                if held >= 16 << 20:
                    yield from _sliced_rows(flush(units))
                    units, held = [], 0
            yield from _sliced_rows(batch_of(spans))
        if units:
            yield from _sliced_rows(flush(units))

    return run


def _common(hashes: PrefixHashes, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Length of the common extension of suffixes ``a`` and ``b``, by binary search on hashes."""
    low = np.zeros(len(a), dtype=np.int64)
    high = np.minimum(a_end - a, b_end - b)
    for _ in range(int(high.max(initial=0)).bit_length()):
        mid = (low + high + 1) // 2
        equal = hashes.of(a, a + mid) == hashes.of(b, b + mid)
        low, high = np.where(equal, mid, low), np.where(equal, high, mid - 1)
    return low


def _before(data: np.ndarray, hashes: PrefixHashes, a, a_end, b, b_end) -> np.ndarray:
    """Whether suffix ``a`` sorts before suffix ``b``; a suffix that ends first is smaller."""
    shared = _common(hashes, a, a_end, b, b_end)
    ends = (a + shared >= a_end) | (b + shared >= b_end)
    at = np.minimum(a + shared, len(data) - 1), np.minimum(b + shared, len(data) - 1)
    return np.where(ends, (a_end - a) < (b_end - b), data[at[0]] < data[at[1]])


def suffix_order(data: np.ndarray, hashes: PrefixHashes, group: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Order of suffixes ``data[start:end]`` inside each group (``group`` ascends).

    A merge sort over all groups at once.  To merge two runs each suffix looks up its place in
    the other run by bisection; a group leaves once a single run of it is left.
    """
    order = np.arange(len(group))
    first = np.searchsorted(group, group, side="left")
    size = np.searchsorted(group, group, side="right") - first
    width = 1
    while True:
        live = np.flatnonzero(size > width)
        if not len(live):
            return order
        place = live - first[live]
        run = place // width
        other = (run ^ 1) * width
        low = np.minimum(other, size[live])
        floor, high = low.copy(), np.minimum(other + width, size[live])
        mine, right = order[live], (run & 1).astype(bool)
        for _ in range(width.bit_length()):
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) // 2
            theirs, own = order[first[live[open_]] + mid], mine[open_]
            # The left run wins ties, so that the order is stable.
            left, later = np.where(right[open_], theirs, own), np.where(right[open_], own, theirs)
            swapped = _before(data, hashes, start[later], end[later], start[left], end[left])
            up = np.where(right[open_], ~swapped, swapped)
            low[open_] = np.where(up, mid + 1, low[open_])
            high[open_] = np.where(up, high[open_], mid)
        target = first[live] + np.minimum(run, run ^ 1) * width + (place - run * width) + (low - floor)
        order[target] = mine
        width *= 2


def repeated_windows(
    key: np.ndarray, doc: np.ndarray, copy: np.ndarray, lo: np.ndarray, hi: np.ndarray,
    at: np.ndarray, pieces: list[bytes], length: int,
) -> tuple[np.ndarray, np.ndarray]:
    """``(unit, window)`` of each window in these units that an earlier one equals.

    Units must be in order of their key.  Earlier means a smaller ``(doc, copy, window)``.
    """
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    offset = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    hashes = PrefixHashes(data)
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    anchor, end = offset[:-1] + (at - lo), offset[1:]
    order = suffix_order(data, hashes, group, anchor, end)

    a, b = order[:-1], order[1:]
    shared = np.where(group[a] == group[b], _common(hashes, anchor[a], end[a], anchor[b], end[b]), -1)
    shared = np.concatenate([[-1], shared])

    # Windows at different distances from their anchors are never equal, so one distance is settled
    # before the next: the memory goes with the units, not with all their windows.
    views = np.lib.stride_tricks.sliding_window_view(data, length) if len(data) >= length else None
    units, windows = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for back in range(int((at - hi).min(initial=0)), int((at - lo).max(initial=-1)) + 1):
        # Windows that start ``back`` bytes before the anchor: their right parts are equal where
        # neighbours share enough, their left parts where the hashes are.
        own = (at - hi <= back) & (back <= at - lo)
        rows = np.flatnonzero(own[order])
        if len(rows) < 2:
            continue
        # A suffix that shares too little with the one before it starts a new block.
        breaks = np.cumsum(shared < length - back)
        picked = order[rows]
        block = breaks[rows]
        twice = np.zeros(len(rows), dtype=bool)
        equal = block[1:] == block[:-1]
        twice[1:] |= equal
        twice[:-1] |= equal
        picked, block = picked[twice], block[twice]
        if not len(picked):
            continue
        left = hashes.of(anchor[picked] - back, anchor[picked])
        by = np.lexsort((at[picked], copy[picked], doc[picked], left, block))
        picked, block, left = picked[by], block[by], left[by]
        new = np.concatenate([[True], (block[1:] != block[:-1]) | (left[1:] != left[:-1])])
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        later = np.flatnonzero(~new)
        # Collision check: the bytes of each later window against those of the first.
        place = anchor[picked] - back
        sure = np.empty(len(later), dtype=bool)
        for k in range(0, len(later), 1 << 14):
            these = later[k : k + (1 << 14)]
            sure[k : k + (1 << 14)] = (views[place[these]] == views[place[head[these]]]).all(axis=1)
        later = picked[later[sure]]
        units.append(later)
        windows.append(at[later] - back)
    return np.concatenate(units), np.concatenate(windows)


def _find_spans(length: int) -> Callable:
    def spans(rows: pa.Table) -> pa.RecordBatch:
        c = {n: rows[n].to_numpy() for n in ("key", "doc", "copy", "lo", "hi", "at")}
        unit, window = repeated_windows(
            c["key"], c["doc"], c["copy"], c["lo"], c["hi"], c["at"], rows["data"].to_pylist(), length
        )
        # Neighbouring windows of a unit become one span.
        order = np.lexsort((window, unit))
        unit, window = unit[order], window[order]
        new = np.ones(len(unit), dtype=bool)
        new[1:] = (unit[1:] != unit[:-1]) | (window[1:] != window[:-1] + 1)
        cut = np.flatnonzero(new)
        last = np.append(cut[1:], len(unit))[: len(cut)] - 1
        columns = [c["doc"][unit[cut]], c["copy"][unit[cut]], window[cut], window[last] + length]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=_SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            known = batch.column("data").is_null()
            yield batch.filter(known).select(_SPANS.names)
            units = batch.filter(pa.compute.invert(known))
            if not units.num_rows:
                continue
            held.append(units)
            size += units.column("data").nbytes
            if size >= _SLAB:
                table = pa.Table.from_batches(held).combine_chunks()
                keys = table["key"].to_numpy()
                # The last key may go on in the next batch.
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield spans(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                size = sum(b.column("data").nbytes for b in held)
        if held:
            yield spans(pa.Table.from_batches(held).combine_chunks())

    return run


def _whole(text: bytes, lo: int, hi: int) -> tuple[int, int]:
    """The part of a span that holds whole UTF-8 characters."""
    while lo < hi and text[lo] & 0xC0 == 0x80:
        lo += 1
    while lo < hi < len(text) and text[hi] & 0xC0 == 0x80:
        hi -= 1
    return lo, hi


def _remove(characters: bool) -> Callable:
    span = pa.struct([("lo", pa.int64()), ("hi", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges, removed = _lists(batch.column("removed"))
            texts, kept, spans = text_bytes(batch.column("text")), [], []
            for k, text in enumerate(texts):
                rows = slice(edges[k], edges[k + 1])
                runs = list(zip(*(x.tolist() for x in _merged(removed["lo"][rows], removed["hi"][rows]))))
                if characters:
                    runs = [(a, b) for a, b in (_whole(text, *r) for r in runs) if a < b]
                starts, ends = [0] + [b for _, b in runs], [a for a, _ in runs] + [len(text)]
                kept.append(b"".join([text[a:b] for a, b in zip(starts, ends)]))
                spans.append([{"lo": a, "hi": b} for a, b in runs])
            sizes = pa.array([len(t) for t in texts], pa.int64())
            columns = {n: batch.column(n) for n in ("doc_id", "copy", "row") if n in batch.schema.names}
            columns |= {"n_bytes": sizes, "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, pa.list_(span))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def numbered(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """``doc_id, doc, copy, text``: one exchange by document, from which every step reads the texts.

    With ``carry`` the other input columns come along as a struct ``row``.

    ``doc`` is ``doc_id`` with a null one put below all others; rows that repeat a ``doc_id`` are
    told apart by ``copy``, in text order.
    """
    columns = F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")
    rows = docs.select(*columns, *carried(docs, carry, without=text))
    rows = rows.withColumn("doc", F.coalesce("doc_id", F.lit(-(1 << 63)))).repartition("doc")
    by = Window.partitionBy("doc").orderBy("text")
    return rows.withColumn("copy", F.row_number().over(by).cast("long"))


def _beside(texts: DataFrame, other: DataFrame, column: str, how: str) -> DataFrame:
    """Put a document's list beside its text.

    The copies are compared without an equi-join key: both sides lie by ``doc`` already.
    """
    other = other.select(F.col("doc").alias("_doc"), F.col("copy").alias("_copy"), column)
    match = (F.col("doc") == F.col("_doc")) & (F.col("copy") - F.col("_copy") == 0)
    return texts.join(other, match, how).select(*texts.columns, column)


def _by_document(rows: DataFrame, name: str, *columns: str | Column) -> DataFrame:
    return (
        rows.repartition("doc").groupBy("doc", "copy")
        .agg(F.collect_list(F.struct(*columns)).alias(name))
    )


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc, copy, removed`` (an array of byte spans, in no order) for rows that lose bytes.

    ``texts`` has the columns of ``numbered``.
    """
    # No filter here: it would sink below the exchange, which could then not be used again.
    # All columns go along for the same reason.
    runs = texts.mapInArrow(_find_runs(length, gram), _ddl(_RUNS))
    known = F.col("shape") < 0
    shape = F.when(known, F.bitwise_not("shape")).otherwise(F.col("shape"))
    copy = F.shiftright(shape, 24)
    surrounding = Window.partitionBy("key", "run").orderBy("doc", "copy", "lo")
    ranked = (
        runs.withColumns({"copy": copy, "known": known, "shape": shape})
        .repartition("key")
        .withColumn("nth", F.row_number().over(surrounding))
        .withColumn("around", F.count_if(F.col("nth") == 1).over(Window.partitionBy("key")))
        .withColumn("gone", F.col("known") | (F.col("nth") > 1))
        .filter("gone OR around > 1")
    )
    hot = (F.col("around") > HOT_RUNS).alias("hot")
    found = _by_document(ranked, "found", "key", "gone", "lo", "shape", hot)
    units = _beside(texts, found, "found", "inner").mapInArrow(_find_units(length), _ddl(_UNITS))
    spans = units.repartition("key").sortWithinPartitions("key").mapInArrow(_find_spans(length), _ddl(_SPANS))
    return _by_document(spans, "removed", "lo", "hi")


def without_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, *, key: str = "doc_id", text: str = "text",
    characters: bool = False, carry: bool = False,
) -> DataFrame:
    """Each row's text without the bytes that a string of ``length`` bytes covers which also starts earlier.

    Earlier is a smaller ``doc_id``, or an earlier byte of the same document; rows that repeat a
    ``doc_id`` count as documents one after the other, in text order, and a null ``doc_id``
    comes first.  Strings are judged on the input, overlaps count, matches never cross documents.

    Returns ``doc_id, copy, n_bytes, kept`` (binary) and ``spans`` (maximal removed runs), and with
    ``carry`` the other input columns as a struct ``row``.  A null text is empty; a text shorter
    than ``length`` keeps every byte.  With ``characters`` a character of which a byte stays stays
    whole, so that ``kept`` is UTF-8.  ``gram`` is at most ``length``, and ``length`` below 4096.
    """
    texts = numbered(docs, key, text, carry)
    removed = repeated_spans(texts, length, gram)
    schema = "n_bytes long, kept binary, spans array<struct<lo: long, hi: long>>"
    return _beside(texts, removed, "removed", "left").mapInArrow(
        _remove(characters), f"doc_id long, copy long, {carried_type(texts)}{schema}"
    )
