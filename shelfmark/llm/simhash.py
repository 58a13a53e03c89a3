"""SimHash near-duplicates, found through variants of fingerprints with some segments or bits left out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import pin
from .common import keyed_text, text_bytes
from .components import components

BITS = 64
SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42

# Texts are similar that have this part of all their five-word shingles in common.
SIMILAR_WORDS = 5
SIMILAR_PERCENT = 80

# By how many independent SimHash words near copies are proposed, of how many words each shingle,
# and by how many bits the nearest of these words may differ, and all of them together.
WORDS = 3
WORD_SHINGLES = 3
WORD_BITS = 5
ALL_BITS = 27

# Which texts are sampled for frequent shingles, from how many of them on a shingle is frequent,
# and how many such shingles every executor gets at most.
SAMPLE_EVERY = 16
COMMON_TIMES = 3
COMMON_SHINGLES = 1 << 20

# Bits by which texts whose sets are compared are told from the others.
SLOT_COUNT = 1 << 24

# An entry's key holds what is kept of a word, modulo a prime below, and the entry's number from here on.
# The prime is far from powers of two, else words that differ in their high and low bits would meet.
_TAG = 48
_PRIME = 135169074042131

# Three of six segments, so that of any four bits one choice holds at most one.
_TRIPLES = [(3, 4, 5), (2, 4, 5), (0, 1, 5), (0, 1, 4), (1, 2, 3), (0, 2, 3)]

# Stands for a null document id where ids are compared.
_NO_ID = -(1 << 63)

# Shingles are hashed and counted this many at a time, so one long text needs no more memory.
_STRIDE = 1 << 16

# Equal parts of the range of hashes in which a set's shingles are counted, up to 16 bits each.
PARTS = 256
_PART_SHIFT = np.uint64(56)
_FULL = (1 << 16) - 1

# Rows whose shingle sets are held together.
_ROWS = 200


def _lane_table() -> np.ndarray:
    """For each byte value, its eight bits spread over the eight bytes of one integer."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return bits.copy().view(np.uint64).ravel()


_LANES = _lane_table()


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set, lowest bit first."""
    lanes = _LANES[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)]
    # A lane is one byte: 255 rows can be added before it could overflow.
    sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
    return sums.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)


# Multipliers by which a shingle's hash is made into those of further, independent words.
_MIXED = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mixed(hashes: np.ndarray, number: int) -> np.ndarray:
    """The hashes for the SimHash word of this number; the first has them as they are."""
    if not number:
        return hashes
    hashes = hashes * _MIXED[number - 1]
    hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ (hashes >> np.uint64(32))


def fingerprint_words(text: bytes, count_words: int, words_each: int, seed: int = SEED) -> list[int]:
    """Independent SimHash words (up to four) of one text: lower-cased ASCII letters, word shingles, repeats counted."""
    words = text.lower().split()
    if not words:
        return [0] * count_words
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    count = max(1, len(words) - words_each + 1)
    first = starts[:count].tolist()
    last = ends[min(words_each, len(words)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros((count_words, BITS), dtype=np.int64)
    for at in range(0, count, _STRIDE):
        spans = zip(first[at : at + _STRIDE], last[at : at + _STRIDE])
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], dtype=np.uint64)
        for number in range(count_words):
            ones[number] += bit_counts(_mixed(hashes, number))
    return np.packbits(2 * ones > count, axis=1, bitorder="little").view("<u8").ravel().tolist()


def fingerprint_of(text: bytes, words_each: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash of one text."""
    return fingerprint_words(text, 1, words_each, seed)[0]


def fingerprints(docs: DataFrame, words_each: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, text_hash, fingerprint`` (a signed bigint with the 64 bits) of every whole text.

    A null, empty or blank text has fingerprint zero; a text of fewer words than a shingle is
    one shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint_of(t, words_each, seed) for t in text_bytes(batch.column("text"))]
            values = np.array(prints, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(values, pa.int64())],
                ["doc_id", "text_hash", "fingerprint"],
            )

    rows = keyed_text(docs).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fingerprint long")


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _segments(parts: int) -> list[tuple[int, int]]:
    """First bit and width of the segments of one 64-bit word."""
    base, more = divmod(BITS, parts)
    widths = [base + (k < more) for k in range(parts)]
    return [(sum(widths[:k]), width) for k, width in enumerate(widths)]


def _hexads() -> list[tuple[int, ...]]:
    """The 132 choices of six of twelve segments that have just one choice among any seven segments.

    This is the Steiner system S(5, 6, 12): the squares modulo 11 with a point at infinity (11), moved
    by ``x + 1`` and ``-1 / x``.  Any five segments are left out by one choice.
    """
    shift = [*((x + 1) % 11 for x in range(11)), 11]
    turn = [11, *(-pow(x, -1, 11) % 11 for x in range(1, 11)), 0]
    found, new = set(), {frozenset((1, 3, 4, 5, 9, 11))}
    while new:
        found |= new
        new = {frozenset(move[x] for x in choice) for choice in new for move in (shift, turn)} - found
    return sorted(tuple(sorted(choice)) for choice in found)


def _masks(choices: Sequence[Sequence[int]], parts: int) -> list[int]:
    """The bits of a word that each choice of its ``parts`` segments keeps."""
    segments = [((1 << width) - 1) << start for start, width in _segments(parts)]
    return [sum(segments[k] for k in choice) for choice in choices]


def _one_left_out(masks: Sequence[int]) -> list[int]:
    """Each mask once for every bit it has, without that bit."""
    return [mask & ~(1 << bit) for mask in masks for bit in range(BITS) if mask >> bit & 1]


def _wide_masks(max_bits: int) -> list[int]:
    """Masks of which two words that differ in ``max_bits`` bits at most differ in one bit on one mask, at most."""
    return _masks(_TRIPLES, 6) if max_bits <= 4 else _masks([(k,) for k in range(max_bits // 2 + 1)], max_bits // 2 + 1)


def _literals(masks: Sequence[int]) -> Column:
    return F.array(*[F.lit(_signed(mask)).cast("long") for mask in masks])


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows over as many tasks as a shuffle has at most, however small they are."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _index(prints: DataFrame, words: Column, masks: Sequence[int], *carried: str) -> DataFrame:
    """``carried`` and ``key``: an entry for each of the array of words under each mask, numbered in that order."""
    rows = prints.select(*carried, F.posexplode(words).alias("_nth", "_word"))
    rows = rows.select(*carried, "_nth", "_word", F.posexplode(_literals(masks)).alias("_which", "_mask"))
    tag = F.shiftleft((F.col("_nth") * len(masks) + F.col("_which")).cast("long"), _TAG)
    kept = F.pmod(F.col("_word").bitwiseAND(F.col("_mask")), F.lit(_PRIME))
    return rows.select(*carried, kept.bitwiseOR(tag).alias("key"))


def _distance(words: Sequence[str], a: str, b: str) -> Column:
    counts = [F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in words]
    return reduce(lambda x, y: x + y, counts)


def _first_left_out(word: str, masks: Sequence[int], a: str, b: str) -> Column:
    """Whether this entry is the first, of masks with one bit left out, on which two prints agree."""
    own = F.shiftrightunsigned(F.col(f"{a}.key"), _TAG).cast("int")
    diff, first, clear, low = F.col(f"{a}.{word}").bitwiseXOR(F.col(f"{b}.{word}")), F.lit(False), F.lit(True), 0
    for mask in masks:
        part = diff.bitwiseAND(F.lit(_signed(mask)))
        at_bit = F.when(part == 0, own == low).otherwise(True)
        first = first | (own.between(low, low + mask.bit_count() - 1) & clear & at_bit)
        clear, low = clear & (F.bit_count(part) > 1), low + mask.bit_count()
    return first


def _agree(diff: Column, masks: Column) -> Column:
    """Whether any of the masks holds none of the bits that differ."""
    return F.exists(masks, lambda mask: diff.bitwiseAND(mask) == 0)


def _first_mask(words: Sequence[str], masks: Sequence[int], a: str, b: str) -> Column:
    """Whether two prints agree under no word and mask before the one of this entry."""
    own, before = F.shiftrightunsigned(F.col(f"{a}.gram"), _TAG).cast("int"), F.lit(False)
    for n, word in enumerate(words):
        count = F.greatest(F.lit(0), F.least(F.lit(len(masks)), own - n * len(masks)))
        diff = F.col(f"{a}.{word}").bitwiseXOR(F.col(f"{b}.{word}"))
        before = before | _agree(diff, F.slice(_literals(masks), F.lit(1), count))
    return ~before


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``u < v`` of distinct fingerprints ``fp`` that differ in at most ``max_bits`` bits.

    The bits are cut into six segments.  Of two fingerprints within four bits there is a choice of
    three segments (of six choices), some 32 bits, on which they differ by one bit at most, so they
    agree on it with that one bit left out; for a wider limit there are ``max_bits // 2 + 1`` segments,
    each a choice.  Each fingerprint is indexed once for each left-out bit and the index is joined to
    itself on equality; the join's condition verifies the distance and lets a pair through at
    its first agreeing entry alone, so no pair is made twice and no copy takes part.

    Spark takes the index to be as small as the fingerprints it is made of, so the join is told not to
    broadcast it, and the fingerprints are dealt to all tasks before they are multiplied.
    """
    masks = _wide_masks(max_bits)
    index = _index(_dealt(prints), F.array("fp"), _one_left_out(masks), "fp").hint("merge")
    a, b = index.alias("a"), index.alias("b")
    verified = (F.col("a.fp") < F.col("b.fp")) & (_distance(["fp"], "a", "b") <= max_bits)
    match = (F.col("a.key") == F.col("b.key")) & verified & _first_left_out("fp", masks, "a", "b")
    return a.join(b, match).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def near_duplicates(
    docs: DataFrame, max_bits: int = MAX_BITS, words_each: int = SHINGLE_WORDS, seed: int = SEED
) -> DataFrame:
    """``doc_id, text_hash, fingerprint, component_id`` of every row.

    ``component_id`` is the smallest ``doc_id`` that can be reached over links of at most
    ``max_bits`` differing bits.  Equal fingerprints, those of null and empty texts included, are
    one node.  Repeated rows keep their rows; a null ``doc_id`` is never the smallest unless
    its component has no other.
    """
    prints = pin(fingerprints(docs, words_each, seed), "prints")
    nodes = prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first_doc"))
    roots = components(links(nodes.select("fp"), max_bits))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "first_doc", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, prints.fingerprint == named.fp).select(
        "doc_id", "text_hash", "fingerprint", "component_id"
    )


def hex_print(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def shingle_set(text: bytes, words_each: int = SIMILAR_WORDS) -> np.ndarray:
    """Distinct hashes of a text's word shingles, in order; a text of fewer words is one shingle."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    count, digest = max(1, len(words) - words_each + 1), xxhash.xxh64_intdigest
    spans = (digest(b" ".join(words[k : k + words_each]), SEED) for k in range(count))
    return np.unique(np.fromiter(spans, dtype=np.uint64, count=count))


def _small(batch: pa.RecordBatch, rows: int = _ROWS) -> Iterator[pa.RecordBatch]:
    """A batch in parts of few rows, so that what is made of their texts leaves the task before the next."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _common_shingles(texts: DataFrame, words_each: int) -> np.ndarray:
    """Shingles that are frequent in a sample of the texts.

    They only decide in which order shingles are indexed, so neither the sample nor the bound
    has a part in what is found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _small(whole)):
            grams = [shingle_set(text, words_each) for text in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64))], ["gram"])

    sample = texts.filter(F.pmod("text_hash", F.lit(SAMPLE_EVERY)) == 0).select("text")
    often = sample.mapInArrow(run, "gram long").groupBy("gram").count().filter(F.col("count") >= COMMON_TIMES)
    found = often.orderBy(F.desc("count"), "gram").select("gram").limit(COMMON_SHINGLES).toArrow()
    return np.sort(found["gram"].to_numpy().astype(np.int64).view(np.uint64))


def _sketch(grams: np.ndarray) -> bytes:
    """How many shingles of a set lie in each of ``PARTS`` equal parts of the hashes."""
    parts = np.bincount((grams >> _PART_SHIFT).astype(np.int64), minlength=PARTS)
    return np.minimum(parts, _FULL).astype("<u2").tobytes()


def shingle_prefixes(texts: DataFrame, words_each: int, percent: int) -> DataFrame:
    """``doc_id, text_hash, node, size, prefix, sketch`` of rows of ``doc_id, text, text_hash``.

    ``node`` stands for the set of shingles.  ``prefix`` has its first shingles in an order that
    is one for all texts (those not known as frequent first, then by hash): as many that two sets
    with ``percent`` of their union in common share one of them.  ``sketch`` counts the shingles in each
    of ``PARTS`` equal parts of the hashes.
    """
    shared = texts.sparkSession.sparkContext.broadcast(_common_shingles(texts, words_each))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.append(shared.value, np.uint64(0))
        for batch in (part for whole in batches for part in _small(whole)):
            nodes, sizes, prefixes, sketches = [], [], [], []
            for text in text_bytes(batch.column("text")):
                grams = shingle_set(text, words_each)
                often = common[np.searchsorted(common[:-1], grams)] == grams
                length = len(grams) - -(-percent * len(grams) // 100) + 1 if len(grams) else 0
                prefixes.append(np.concatenate([grams[~often], grams[often]])[:length].view(np.int64))
                nodes.append(xxhash.xxh64_intdigest(grams.tobytes(), SEED))
                sizes.append(len(grams))
                sketches.append(_sketch(grams))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"),
                 pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int64()),
                 pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                ["doc_id", "text_hash", "node", "size", "prefix", "sketch"],
            )

    return texts.mapInArrow(run, "doc_id long, text_hash long, node long, size long, prefix array<long>, sketch binary")


def _may_share(a: str, b: str, percent: int) -> Column:
    """Whether sets with a common shingle at places ``at`` can have ``percent`` of their union in common.

    Said of the first common shingle, which every pair that does has in both prefixes.
    """
    size, other = F.col(f"{a}.size"), F.col(f"{b}.size")
    most = F.least(size - F.col(f"{a}.at"), other - F.col(f"{b}.at"))
    return most * (100 + percent) >= F.lit(percent) * (size + other)


def possible_pairs(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs ``u, v`` whose sets can have ``percent`` of their union in common, by their sketches.

    Two sets share in no part more than the smaller of both counts, so no pair is lost by this; only
    what it leaves has to be compared by whole sets.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _small(whole, 4096)):
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(-1, PARTS).astype(np.int64) for c in ("a", "b"))
            least = np.minimum(a, b)
            both, each = least.sum(axis=1), a.sum(axis=1) + b.sum(axis=1)
            good = (100 * both >= percent * (each - both)) | (least == _FULL).any(axis=1)
            kept = pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"])
            yield kept.filter(pa.array(good))

    left = sketches.select(F.col("node").alias("u"), F.col("sketch").alias("a"))
    right = sketches.select(F.col("node").alias("v"), F.col("sketch").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(keep, "u long, v long")


def _wanted_sets(texts: DataFrame, wanted: DataFrame, words_each: int) -> DataFrame:
    """``node, grams`` of the nodes whose rows ``wanted`` names by text hash, and of few others.

    A bitmap of fixed size tells which texts to read, so that no text is exchanged.
    """
    slot = F.col("text_hash").bitwiseAND(F.lit(SLOT_COUNT - 1)).cast("int")
    slots = np.zeros(SLOT_COUNT, dtype=bool)
    slots[wanted.select(slot.alias("slot")).distinct().toArrow()["slot"].to_numpy()] = True
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in (part for whole in batches for part in _small(whole)):
            at = batch.column("text_hash").to_numpy() & (SLOT_COUNT - 1)
            some = batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))
            grams = [shingle_set(t, words_each).tobytes() for t in text_bytes(some.column("text"))]
            nodes = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes.view(np.int64)), pa.array(grams, pa.binary())], ["node", "grams"]
            )

    found = texts.select("text_hash", "text").mapInArrow(run, "node long, grams binary")
    return found.groupBy("node").agg(F.first("grams").alias("grams"))


def verified_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``u, v`` of nodes whose sets have at least ``percent`` of their union in common."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _small(whole)):
            good = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * both >= percent * (len(a) + len(b) - both))
            kept = pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"])
            yield kept.filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("node").alias("u"), F.col("grams").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("grams").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(compare, "u long, v long")


def similar_documents(
    docs: DataFrame, *, words_each: int = SIMILAR_WORDS, percent: int = SIMILAR_PERCENT
) -> DataFrame:
    """``doc_id, text_hash, component_id, first_id, first_hash`` of every row, for similar texts.

    Texts are linked where their sets of word shingles have at least ``percent`` of their union
    in common, and only there.  Candidates are all pairs with a common shingle in their prefixes,
    which misses no such pair; each that its sketches allow is then compared by its whole sets.  Every set is compared
    with the smallest node at each of its prefix shingles first, and only pairs that these
    links leave in different components are compared after that: a dense group needs comparisons
    in proportion to its members.  ``first_id`` and ``first_hash`` name the row that stands for
    the component: the smallest ``doc_id``, a null one only if there is no other, then the
    smallest text hash.
    """
    texts = keyed_text(docs).withColumn("text_hash", F.xxhash64("text"))
    prints = pin(shingle_prefixes(texts, words_each, percent), "prints")
    low = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    nodes = pin(prints.groupBy("node").agg(F.min(low).alias("first")), "nodes")

    sets = prints.dropDuplicates(["node"]).select("node", "size", F.posexplode("prefix").alias("at", "gram"))
    sets = _shared(sets, "size", "at")
    linked = _comparison(sets, prints, texts, nodes, words_each, percent)
    links_ = _links_in_groups(sets, lambda a, b: _may_share(a, b, percent), linked, "size", "at")
    return _named(prints, nodes, links_)


def fingerprint_sets(texts: DataFrame, words_each: int) -> DataFrame:
    """``doc_id, text_hash, node, words, sketch`` of rows of ``doc_id, text, text_hash``: set of shingles and SimHash words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _small(whole)):
            nodes, prints, sketches = [], [], []
            for text in text_bytes(batch.column("text")):
                grams = shingle_set(text, words_each)
                nodes.append(xxhash.xxh64_intdigest(grams.tobytes(), SEED))
                sketches.append(_sketch(grams))
                prints.append(np.array(fingerprint_words(text, WORDS, WORD_SHINGLES), dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"),
                 pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(prints, pa.list_(pa.int64())),
                 pa.array(sketches, pa.binary())],
                ["doc_id", "text_hash", "node", "words", "sketch"],
            )

    return texts.mapInArrow(run, "doc_id long, text_hash long, node long, words array<long>, sketch binary")


def near_copies(docs: DataFrame, *, words_each: int = SIMILAR_WORDS, percent: int = SIMILAR_PERCENT) -> DataFrame:
    """What ``similar_documents`` returns, with the candidates proposed by SimHash.

    A text has ``WORDS`` independent SimHash words.  Texts of which one word differs by at most
    ``WORD_BITS`` bits, and all together by ``ALL_BITS``, are candidates.  They are found by equal words with
    six of twelve segments left out, in 132 ways of which one leaves out any five differing bits: the
    32 bits that stay hardly ever meet by chance.  Candidates are linked where their whole sets of shingles
    have ``percent`` of their union in common; a pair little above that share may not be proposed.
    """
    texts = keyed_text(docs).withColumn("text_hash", F.xxhash64("text"))
    prints = pin(fingerprint_sets(texts, words_each), "prints")
    low = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    nodes = pin(prints.groupBy("node").agg(F.min(low).alias("first"), F.min("words").alias("words")), "nodes")

    names, masks = [f"w{n}" for n in range(WORDS)], _masks(_hexads(), 12)
    words = nodes.select("node", *[F.get("words", F.lit(n)).alias(name) for n, name in enumerate(names)])
    sets = _shared(_index(nodes, F.col("words"), masks, "node").withColumnRenamed("key", "gram"))

    def close(a: str, b: str) -> Column:
        each = [_distance([name], a, b) for name in names]
        return (F.least(*each) <= WORD_BITS) & (_distance(names, a, b) <= ALL_BITS)

    linked = _comparison(sets, prints, texts, nodes, words_each, percent)
    links_ = _links_in_groups(
        sets, close, linked, *names, described=words, once=lambda a, b: _first_mask(names, masks, a, b)
    )
    return _named(prints, nodes, links_)


def _shared(sets: DataFrame, *carried: str) -> DataFrame:
    """The entries ``node, gram`` of grams that several nodes have, each with the smallest of these nodes (``low``)."""
    by = Window.partitionBy("gram")
    sets = sets.repartition("gram").withColumns({
        "low": F.min(F.struct("node", *carried)).over(by), "high": F.max("node").over(by),
    })
    return pin(sets.filter("low.node < high").drop("high"), "shared")


def _links_left(links_: DataFrame) -> DataFrame:
    """Links ``u, v`` of each node with the smallest of its component: they connect the same, with a row a node at most."""
    return components(links_).withColumnsRenamed({"node": "u", "root": "v"})


def _apart(pairs: DataFrame, links_: DataFrame) -> DataFrame:
    """The pairs ``u, v`` whose ends are in different components of ``links_``, as ``_links_left`` has them."""
    for end in ("u", "v"):
        own = links_.select(F.col("u").alias(end), F.col("v").alias(f"_{end}"))
        pairs = pairs.join(own, end, "left")
    return pairs.filter(F.coalesce("_u", "u") != F.coalesce("_v", "v")).select("u", "v")


def _links_in_groups(
    sets: DataFrame, close: Callable[[str, str], Column], linked: Callable[[DataFrame], DataFrame], *carried: str,
    described: DataFrame | None = None, once: Callable[[str, str], Column] = lambda a, b: F.lit(True),
) -> DataFrame:
    """Links ``u, v`` that connect what all linked pairs with a common gram would.

    ``close`` tells of two entries of a gram whether they are candidates, ``linked`` which candidates
    are links.  Each node is compared with the smallest candidate that is the smallest node at one of its grams,
    then with the other such ones where these links leave it in another component, and then only
    with those that are left in another component still, at the gram that ``once`` lets through.
    ``carried`` are columns of the entries, or else of ``described``, which has a row for each node.
    """
    to_low = sets.filter((F.col("node") > F.col("low.node")))
    if described is None:
        to_low = to_low.select(F.struct("node", *carried).alias("a"), F.col("low").alias("b"))
    else:
        # Each pair once, however many grams it has in common.
        met, end = to_low.select("node", F.col("low.node").alias("_low")).distinct(), F.struct("node", *carried)
        to_low = met.join(described.select("node", end.alias("a")), "node")
        to_low = to_low.join(described.select(F.col("node").alias("_low"), end.alias("b")), "_low").select("a", "b")
    near = to_low.filter(close("a", "b")).select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()
    near = pin(near.withColumn("least", F.min("v").over(Window.partitionBy("u"))), "near")
    links_ = _links_left(linked(pin(near.filter("v = least").select("u", "v"), "least")))
    rest = _apart(near.filter("v > least").select("u", "v"), links_)
    links_ = _links_left(links_.union(linked(pin(rest, "rest"))))

    by = Window.partitionBy("gram")
    roots = links_.withColumnsRenamed({"u": "_node", "v": "_root"})
    above, comp = sets.filter(F.col("node") > F.col("low.node")), F.coalesce("_root", "node").alias("comp")
    whose = (above if described is None else described).join(roots, F.col("node") == F.col("_node"), "left")
    if described is None:
        comps = whose.select("node", *carried, "gram", comp)
    else:
        # One join gives an entry both what describes its node and its component.
        comps = above.select("node", "gram").join(whose.select("node", *carried, comp), "node")
    comps = comps.repartition("gram").withColumns({"one": F.min("comp").over(by), "other": F.max("comp").over(by)})
    comps = pin(comps.filter("one < other"), "open")
    a, b = comps.alias("a"), comps.alias("b")
    match = (
        (F.col("a.gram") == F.col("b.gram")) & (F.col("a.comp") != F.col("b.comp"))
        & (F.col("a.node") < F.col("b.node")) & close("a", "b") & once("a", "b")
    )
    far = a.join(b, match).select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()
    return links_.union(linked(pin(far, "far")))


def _comparison(
    sets: DataFrame, prints: DataFrame, texts: DataFrame, nodes: DataFrame, words_each: int, percent: int
) -> Callable[[DataFrame], DataFrame]:
    """What tells which pairs of nodes are links: by their sketches, then by their whole sets."""
    met = sets.select("node").distinct()
    sketches = pin(prints.join(met, "node", "left_semi").groupBy("node").agg(F.first("sketch").alias("sketch")), "sketches")

    def linked(pairs: DataFrame) -> DataFrame:
        left = pin(possible_pairs(pairs, sketches, percent), "possible")
        ends = left.select("u").union(left.select("v")).distinct().withColumnRenamed("u", "node")
        wanted = nodes.join(ends, "node").select("first.text_hash")
        own = pin(_wanted_sets(texts, wanted, words_each), "sets")
        return pin(verified_links(left, own, percent), "links")

    return linked


def _named(prints: DataFrame, nodes: DataFrame, links_: DataFrame) -> DataFrame:
    """Every row with its component and the row that stands for it."""
    roots = components(links_).withColumnRenamed("node", "_node")
    rooted = nodes.join(roots, F.col("node") == F.col("_node"), "left")
    rooted = pin(rooted.select("node", "first", F.coalesce("root", "node").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    named = rooted.select("node", "root").join(least, "root").withColumnRenamed("node", "_own")
    return prints.join(named, F.col("node") == F.col("_own")).select(
        "doc_id", "text_hash", F.col("root").alias("component_id"),
        F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"),
    )


def one_of_each(docs: DataFrame, found: DataFrame | None = None, **options: int) -> DataFrame:
    """The rows of ``docs`` with one of each component of ``found`` (else of ``similar_documents``); equal rows are one."""
    found = similar_documents(docs, **options) if found is None else found
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash")))
    stays = first.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("_stays"), F.col("text_hash").alias("_as")).distinct()
    stays = pin(stays, "stays")
    marks = {"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), "_hash": F.xxhash64(F.col("text").cast("string"))}
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *[m.alias(n) for n, m in marks.items()]).repartition("_id")
    # The exchange by document serves both: equal rows are numbered, then looked up.
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_hash").orderBy("_id")))
    match = (F.col("_id") == F.col("_stays")) & (F.col("_hash").bitwiseXOR(F.col("_as")) == 0)
    return rows.filter("_nth = 1").join(stays, match, "left_semi").select("_row.*")
