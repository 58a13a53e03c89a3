"""Token ids of a corpus in plane-shuffled, compressed blocks, in order of the documents.

A token file is a table whose rows are *segments*: some whole documents' ids, one after the other.
``data`` holds a segment's ids in blocks of a fixed number of ids.  A block is transposed into
planes (all first bytes, then all second bytes and so on; or likewise with bits), and each plane
is compressed by itself, so that the high planes, nearly all zero, take next to no room.  In front
of the planes stands the chunk index with the length of every compressed plane, so one block can
be read without the others::

    magic 4 bytes | kind (b or B) 1 | block ids u32 | ids u64 | index u32 * planes * blocks | planes

The other columns are the index of segments: ``shard`` and ``first_id`` (ids of the shard in front
of the segment), ``n_ids``, and ``doc_ids`` and ``lengths`` of its documents.  Spark's own writer
commits the files, so a task that runs twice leaves one copy.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import keyed_text, sliced

MAGIC = b"PLN1"
BLOCK_IDS = 1 << 14
SEGMENT_IDS = 1 << 19
END_ID = 2
LEVEL = 3

# Distinct words whose ids a task remembers; beyond that it starts over.
REMEMBERED = 1_000_000

_HEAD = "<4scIQ"
_PLANES = {b"B": 4, b"b": 32}


def to_planes(ids: np.ndarray, kind: bytes = b"B") -> np.ndarray:
    """One row of bytes for each plane of a block of 32-bit ids."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == b"B":
        return np.ascontiguousarray(rows.T)
    return np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1)


def from_planes(planes: np.ndarray, count: int, kind: bytes = b"B") -> np.ndarray:
    if kind == b"b":
        bits = np.unpackbits(planes, axis=1, count=count).T
        planes = np.packbits(bits, axis=1, bitorder="little").T
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack(ids: np.ndarray, kind: bytes = b"B", block_ids: int = BLOCK_IDS, level: int = LEVEL) -> bytes:
    """A segment's ids as bytes: header, chunk index, compressed planes."""
    squeeze = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
    planes = [
        squeeze(plane.tobytes())
        for at in range(0, len(ids), block_ids)
        for plane in to_planes(ids[at : at + block_ids], kind)
    ]
    index = np.array([len(p) for p in planes], dtype="<u4").tobytes()
    return b"".join([struct.pack(_HEAD, MAGIC, kind, block_ids, len(ids)), index, *planes])


def unpack(data: bytes, first_block: int = 0, blocks: int | None = None) -> np.ndarray:
    """Ids of a segment, or of some of its blocks alone."""
    magic, kind, block_ids, count = struct.unpack_from(_HEAD, data)
    if magic != MAGIC or kind not in _PLANES:
        raise ValueError("not a segment of plane-shuffled ids")
    each, total = _PLANES[kind], -(-count // block_ids)
    sizes = np.frombuffer(data, dtype="<u4", count=each * total, offset=struct.calcsize(_HEAD))
    places = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]) + struct.calcsize(_HEAD) + sizes.nbytes
    last = total if blocks is None else min(total, first_block + blocks)
    open_ = zstandard.ZstdDecompressor().decompress
    out = [np.empty(0, dtype="<u4")]
    for block in range(first_block, last):
        n = min(block_ids, count - block * block_ids)
        rows = range(block * each, block * each + each)
        planes = [np.frombuffer(open_(data[places[r] : places[r + 1]]), dtype=np.uint8) for r in rows]
        out.append(from_planes(np.stack(planes), n, kind))
    return np.concatenate(out)


class WordTokens:
    """Ids of texts by the tokenizers library, asked once for each distinct word.

    White space between words neither reaches a token nor joins its neighbours in this kind of
    vocabulary, so a text's ids are those of its words in order.  Words of letters alone, whatever
    stops follow them, go to the library many at a time: each then ends at the next token that
    ends a word.
    """

    STOPS = ".,!?;:"
    WORD_END = "</w>"

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith(self.WORD_END)]] = True
        self.encode_batch = tokenizer.encode_batch_fast
        self.remembered, self.known = remembered, {}

    def _each(self, words: list[str]) -> list[bytes]:
        found = self.encode_batch(words, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _together(self, stems: list[str]) -> list[bytes]:
        """Ids of words that are letters alone."""
        (found,) = self.encode_batch([" ".join(stems)], add_special_tokens=False)
        ids = np.array(found.ids, dtype="<u4")
        last = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        if len(last) != len(stems):
            return self._each(stems)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *last], last)]

    def learn(self, words: set[bytes]) -> None:
        """Ask for the ids of words that are not known."""
        plain, other, letters, stops = [], [], set(), set()
        for word in words:
            text = word.decode()
            stem = text.rstrip(self.STOPS)
            # A letter may turn into one and a mark in lower case, which would meet the stop.
            if stem.isalpha() and (stem.isascii() or stem.lower().isalpha()):
                own, stop = word[: len(word) - len(text) + len(stem)], text[len(stem) :].encode()
                letters.add(own)
                if stop:
                    stops.add(stop)
                    plain.append((word, own, stop))
            else:
                other.append(word)
        known = self.known
        stems = list(letters.difference(known))
        other += stops.difference(known)
        if stems:
            known.update(zip(stems, self._together([x.decode() for x in stems])))
        known.update(zip(other, self._each([x.decode() for x in other])))
        known.update([(word, known[stem] + known[stop]) for word, stem, stop in plain])

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        # The vocabulary is lower case; only its special tokens must stay as they are written.
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        words = set().union(*split)
        if len(self.known) + len(words) > self.remembered:
            self.known.clear()
        self.learn(words.difference(self.known))
        known = self.known.__getitem__
        for own in split:
            yield np.frombuffer(b"".join(map(known, own)), dtype="<u4")


_SEGMENTS = pa.schema([
    ("shard", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("data", pa.binary()),
])
_SEGMENTS_DDL = "shard int, first_id long, n_ids long, doc_ids array<long>, lengths array<long>, data binary"


def _write_segments(tokenizer_path: str, end_id: int, kind: bytes, segment_ids: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encoder = TaskContext.get().partitionId(), WordTokens(tokenizer_path)
        end, first = np.array([end_id], dtype="<u4"), 0
        keys, parts, held = [], [], 0

        def segment() -> pa.RecordBatch:
            ids = np.concatenate([x for part in parts for x in (part, end)])
            lengths = [len(p) + 1 for p in parts]
            row = [[shard], [first], [len(ids)], [keys], [lengths], [pack(ids, kind)]]
            arrays = [pa.array(c, f.type) for c, f in zip(row, _SEGMENTS)]
            return pa.RecordBatch.from_arrays(arrays, schema=_SEGMENTS)

        for batch in batches:
            for some_keys, texts in sliced(batch):
                for key, ids in zip(some_keys, encoder.encode(texts)):
                    keys.append(key)
                    parts.append(ids)
                    held += len(ids) + 1
                    if held >= segment_ids:
                        yield segment()
                        first += held
                        keys, parts, held = [], [], 0
        if parts:
            yield segment()

    return run


def write_tokens(
    docs: DataFrame, tokenizer_path: str, path: str, *, end_id: int = END_ID, kind: bytes = b"B",
    segment_ids: int = SEGMENT_IDS, shards: int | None = None, key: str = "doc_id", text: str = "text",
) -> None:
    """Write every document's ids and ``end_id``, in ascending ``doc_id`` order, to ``path``.

    A null ``doc_id`` comes first, rows that repeat one follow in text order; a null or empty text
    has the end id alone.  ``shards`` are by default a quarter of the shuffle partitions: a task
    asks the library for each word once, so longer tasks ask less.
    """
    spark = docs.sparkSession
    shards = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    ordered = (
        keyed_text(docs, key, text)
        .repartitionByRange(shards, "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    segments = ordered.mapInArrow(_write_segments(tokenizer_path, end_id, kind, segment_ids), _SEGMENTS_DDL)
    # The planes are compressed already.
    segments.write.option("compression", "none").parquet(path)


def _read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            shard, first, _, keys, lengths, data = (batch.column(k)[row].as_py() for k in range(6))
            ids = unpack(data)
            edges = np.concatenate([[0], np.cumsum(lengths)]).tolist()
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard] * len(keys), pa.int32()), pa.array(keys, pa.int64()),
                    pa.array([first + e for e in edges[:-1]], pa.int64()),
                    pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()),
                ],
                ["shard", "doc_id", "local_start", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document of a token file, from its planes."""
    segments = spark.read.schema(_SEGMENTS_DDL).parquet(path)
    # One row a shard: the ids of all shards in front of it.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = (
        segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
        .select(F.col("shard").alias("_shard"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    )
    found = segments.mapInArrow(
        _read_documents, "shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long"
    )
    return found.join(shards, found.shard == shards._shard).select(
        "doc_id", (F.col("_before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )
