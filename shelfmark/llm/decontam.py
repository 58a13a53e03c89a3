"""Benchmark passages in documents, found by spaced seeds and verified word by word."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import let

# Which words of a window count, ignoring what was substituted elsewhere, for an overlap of so
# many words: wherever a quarter of these (rounded down) is substituted, one of the masks lies on
# none of the substituted places.
_WIDE = ("1101100101", "1010011011", "11110101", "1110000001011", "10100100001011", "11010000100011")
MASKS = {
    16: _WIDE, 15: _WIDE, 14: _WIDE,
    13: (*_WIDE[:4], "11001010011", "100110100011"),
    12: (*_WIDE[:3], "110001111", "1101111", "11100100011", "10110111", "11010001101"),
    11: (*_WIDE[:3], "1110111", "1011111"),
    10: (*_WIDE[:3], "1101111", "110100111", "111111"),
    9: ("11110101", "111011", "1001111", "11010011"),
    8: ("11110101", "11111", "111011", "110111", "11100011", "101111", "11010011", "1100111"),
    7: ("111111", "1111101", "1111011", "1110111", "1101111", "1011111"),
    6: ("11111", "111101", "111011", "110111", "101111"),
    5: ("1111", "11101", "11011", "10111"),
    4: ("111", "1101", "1011"),
    3: ("111",), 2: ("11",), 1: ("1",),
}

# An overlap is this many aligned words (a whole item if it has fewer) of which this part is equal.
OVERLAP_WORDS = 16
LEAST_EQUAL = 0.75

# Up to this many seeds (16 bytes each) the benchmark goes to every executor; beyond, to a
# shuffled join.
BROADCAST_SEEDS = 1_000_000

# Bits, as a power of two, of the tables by which words and seeds are tested in the row, at most.
SLOT_BITS = 22

_NOT_WORD = r"[^\p{L}\p{N}]+"

# Letters of scripts that leave no space between words.
_UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; a null text has none.

    A letter of a script without spaces is a word of its own.
    """
    lower = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    lower = F.when(lower.rlike(_UNSPACED), F.regexp_replace(lower, _UNSPACED, " $1 ")).otherwise(lower)
    return F.filter(F.split(lower, _NOT_WORD), lambda w: w != "")


def _windows(starts: Column, hashes: Column, mask: str, number: int) -> Column:
    """``(at, seed)`` of a mask laid on the words at ``starts``, where it does not stand out behind."""
    picked = [k for k, bit in enumerate(mask) if bit == "1"]

    def seed(at: Column) -> Column:
        return F.struct(
            at.alias("at"), F.xxhash64(F.lit(number), *[F.get(hashes, at + k) for k in picked]).alias("seed")
        )

    inside = F.filter(starts, lambda at: at <= F.size(hashes) - len(mask))
    return F.transform(inside, seed)


def seeds(
    hashes: Column, masks: Sequence[str], wanted: Mapping[str, Column] | None = None, starts: Column | None = None
) -> Column:
    """``(at, seed)`` of every window and mask (where it is ``wanted``) over an array of word hashes.

    ``starts`` are the places to look at, by default all.  An array shorter than a mask has no window of it.
    """
    none = F.array().cast("array<struct<at: int, seed: bigint>>")
    everywhere = F.when(F.size(hashes) > 0, F.sequence(F.lit(0), F.size(hashes) - 1)).otherwise(F.array().cast("array<int>"))

    def of(mask: str) -> Column:
        found = _windows(everywhere if starts is None else starts, hashes, mask, masks.index(mask))
        return F.when(wanted[mask], found).otherwise(none) if wanted else found

    return F.concat(*[of(m) for m in masks])


def _hashed(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def least_run(width: int, least_equal: float = LEAST_EQUAL) -> int:
    """How many neighbouring words are equal at least somewhere in an overlap of ``width`` words."""
    equal = math.ceil(width * least_equal)
    return -(-equal // (width - equal + 1))


def _runs(hashes: Column, run: int) -> Column:
    """A hash of every ``run`` neighbouring words; the last places have fewer."""
    return F.transform(hashes, lambda w, k: F.xxhash64(w, *[F.get(hashes, k + n) for n in range(1, run)]))


class Slots:
    """Two bits for each of some hashes, to test others against: no hash is missed, few others pass.

    The table has some ``each`` bits to a hash, up to ``SLOT_BITS``; beyond that more others pass.
    """

    def __init__(self, hashes: DataFrame, name: str, each: int):
        count = hashes.select(name).distinct().count()
        self.size = 1 << min(SLOT_BITS, max(10, (each * count).bit_length()))
        one = F.expr("shiftleft(1L, CAST(_slot & 63 AS INT))")
        filled = (
            hashes.select(F.explode(F.array(*self._slots(F.col(name)))).alias("_slot"))
            .groupBy(F.shiftright("_slot", 6).alias("word")).agg(F.bit_or(one).alias("bits"))
        )
        # One row for each 64 bits at most.
        of = {r.word: r.bits for r in filled.collect()}
        self.table = ",".join(str(of.get(k, 0)) for k in range(self.size >> 6))

    def _slots(self, value: Column) -> list[Column]:
        return [v.bitwiseAND(F.lit(self.size - 1)) for v in (value, F.shiftright(value, 32))]

    def has(self, value: Column) -> Column:
        table = F.split(F.lit(self.table), ",").cast("array<bigint>")  # folded into one literal
        first, second = (
            F.getbit(F.get(table, F.shiftright(s, 6).cast("int")), s.bitwiseAND(F.lit(63)).cast("int")) == 1
            for s in self._slots(value)
        )
        return first & second


def _most_equal(around: Column, at: Column, item: Column, item_at: Column, width: Column, reach: int) -> Column:
    """Most equal words in any ``width`` neighbouring words of the item that begin up to ``reach`` before the seed.

    ``around`` has the text's words from ``reach`` (or ``at``, if less) before the seed on.  Bit ``k``
    says whether the item's word ``reach`` before the seed plus ``k`` is equal.
    """
    before = F.least(at, F.lit(reach))
    place = F.sequence(F.lit(0), F.lit(2 * reach))

    def equal(bits: Column, k: Column) -> Column:
        same = F.coalesce(F.get(item, item_at - reach + k) == F.get(around, before - reach + k), F.lit(False))
        return F.when(same, bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))).otherwise(bits)

    def most(bits: Column) -> Column:
        ones = F.call_function("shiftleft", F.lit(1).cast("long"), width) - 1
        first, last = F.greatest(F.lit(0), reach - item_at), F.least(F.lit(reach), F.size(item) - width - item_at + reach)
        held = lambda k: F.bit_count(F.call_function("shiftrightunsigned", bits, k).bitwiseAND(ones))
        return F.array_max(F.transform(F.sequence(first, last), held))

    return let(F.aggregate(place, F.lit(0).cast("long"), equal), most)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", masks: Mapping[int, Sequence[str]] = MASKS,
    overlap_words: int = OVERLAP_WORDS, least_equal: float = LEAST_EQUAL,
    broadcast_seeds: int = BROADCAST_SEEDS,
) -> DataFrame:
    """``doc_id, text_hash, item_id, equal_words, of_words`` for each text that holds a benchmark passage.

    A pair is reported where a seed of the item occurs in the text and, with the item laid on the
    text at that place, some ``overlap_words`` neighbouring words (the whole item, if it has fewer)
    agree in ``least_equal`` of their places.  ``equal_words`` is the most that agree.  ``masks``
    has the seeds for overlaps of each length; the given ones find every overlap for the given
    bounds.  A text without words holds nothing.  Rows that repeat both key and text are one;
    ``text_hash`` (of the text as it is) tells rows apart that share a key.

    Masks are laid only near places where some neighbouring words stand in the benchmark as well: every
    overlap has such a run, as its few substituted words cannot part it into shorter ones.  Only
    seeds that the benchmark has leave the row, each with the words around it, so that it is
    verified where it is joined and no text is exchanged.
    """
    if not 1 < overlap_words <= 32:
        raise ValueError("an overlap has 2 to 32 words")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    items = benchmark.select(F.col(item_key).alias("item_id"), _hashed(F.col(item_text)).alias("item"))
    items = items.filter(F.size("item") > 0).distinct()
    width = F.least(F.size("item"), F.lit(overlap_words))
    # Texts are seeded for the lengths that the items have, of which there are few.
    widths = sorted(r.width for r in items.select(width.alias("width")).distinct().collect())
    used = list(dict.fromkeys(m for w in widths for m in masks[w])) or ["1"]
    wanted = {m: width.isin([w for w in widths if m in masks[w]]) for m in used}
    item_seeds = (
        items.select("item_id", F.explode(seeds(F.col("item"), used, wanted)).alias("s"))
        .select("item_id", F.col("s.at").alias("item_at"), F.col("s.seed").alias("item_seed"))
    )
    # The size decides between two plans with equal results.
    small = item_seeds.limit(broadcast_seeds + 1).count() <= broadcast_seeds
    near = (lambda df: F.broadcast(df)) if small else (lambda df: df)

    run, reach = min([least_run(w, least_equal) for w in widths] or [1]), overlap_words - 1
    item_runs = Slots(items.select(F.explode(_runs(F.col("item"), run)).alias("run")), "run", 64)
    item_slots = Slots(item_seeds, "item_seed", 16)

    # Every array is bound once for the whole row; a filter between these steps would be pushed below
    # them and work them out again for each place.
    def known(hashes: Column) -> Column:
        def shared(runs: Column) -> Column:
            return F.filter(F.sequence(F.lit(0), F.size(runs) - 1), lambda k: item_runs.has(F.get(runs, k)))

        def starts(places: Column) -> Column:
            last = F.size(hashes) - 1
            reached = lambda k: F.sequence(F.greatest(k - reach, F.lit(0)), F.least(k + reach, last))
            return F.array_distinct(F.flatten(F.transform(places, reached)))

        def seed(s: Column) -> Column:
            before = F.least(s.at, F.lit(reach))
            return F.struct(
                s.at.alias("at"), s.seed.alias("seed"), F.slice(hashes, s.at - before + 1, before + reach + 1).alias("around")
            )

        seeded = lambda places: F.filter(seeds(hashes, used, starts=places), lambda s: item_slots.has(s.seed))
        found = let(let(_runs(hashes, run), shared), lambda places: let(starts(places), seeded))
        return F.when(F.size(hashes) > 0, F.transform(found, seed))

    found = rows.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.explode(let(_hashed(F.col("text")), known)).alias("s")
    ).select("doc_id", "text_hash", "s.*")
    beside = found.join(near(item_seeds), F.col("seed") == F.col("item_seed")).join(near(items), "item_id")
    beside = beside.withColumn("of_words", width)
    equal = _most_equal(F.col("around"), F.col("at"), F.col("item"), F.col("item_at"), F.col("of_words"), reach)
    return (
        beside.withColumn("equal_words", equal)
        .filter(F.col("equal_words") >= F.ceil(F.col("of_words") * least_equal))
        .groupBy("doc_id", "text_hash", "item_id")
        .agg(F.max("equal_words").alias("equal_words"), F.first("of_words").alias("of_words"))
    )
