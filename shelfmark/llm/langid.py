"""Language identification with one Bloom filter whose slots hold a bit for every language."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..scratch import pin
from .common import carried, carried_type, keyed_text

GRAM = 4
SLOTS = 1 << 21
PROBES = 3

# A filter has at least this many slots for each gram, so it grows with what there is to tell apart.
SLOTS_EACH = 4

# A gram is a language's own from this part of the share that it has in the language where it is
# most common, so that wrongly labelled rows do not make all grams everyone's.
LEAST_PART = 0.2

UNKNOWN = "und"
# Languages in one bitmask; there are as many masks a slot as the languages need.
MASK_BITS = 63

_MIX = np.uint64(0x9E3779B97F4A7C15)


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool)


def gram_hashes(texts: list[str], gram: int, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every letter n-gram, all texts at once.

    Texts are lower-cased and everything between letters is one space; a text has a space more
    than a gram can skip on both sides, so one with a single letter has grams too.
    """
    codes, owners = [], []
    for k, text in enumerate(texts):
        code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = letters[code]
        code = np.where(letter, code, 0)
        code = code[letter | np.concatenate([[True], letter[:-1]])] if len(code) else code
        if not code.any():
            continue
        edge = np.zeros(gram - 2, dtype=np.uint32)
        code = np.concatenate([edge, code, edge])
        codes.append(code)
        owners.append(np.full(len(code), k))
    if not codes:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    code, owner = np.concatenate(codes).astype(np.uint64), np.concatenate(owners)
    n = len(code) - gram + 1
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(gram):
        mixed = (mixed ^ code[k : k + n]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    own = owner[:n] == owner[gram - 1 :]
    return mixed[own], owner[:n][own]


# Rows that leave a task together: a carried row goes back as it came, so a batch is held twice.
_ROWS = 1000


def _grouped(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[tuple[list, list]]:
    """Rows (all columns but the text, and the text) some ``limit`` characters at a time."""
    rows, texts, size = [], [], 0
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        for *rest, text in zip(*columns):
            rows.append(rest)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= limit:
                yield rows, texts
                rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def _count(gram: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for rows, texts in _grouped(batches):
            langs = sorted({r[0] for r in rows})
            number = {lang: k for k, lang in enumerate(langs)}
            lang = np.array([number[r[0]] for r in rows])
            hashes, owner = gram_hashes(texts, gram, letters)
            for k, name in enumerate(langs):
                values, counts = np.unique(hashes[lang[owner] == k], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(values), pa.string()), pa.array(values.view(np.int64)),
                     pa.array(counts, pa.int64())],
                    ["lang", "gram", "n"],
                )

    return run


def gram_counts(labelled: DataFrame, gram: int = GRAM) -> DataFrame:
    """``lang, gram, n`` over all rows of ``lang, text``; null languages and texts are left out."""
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    found = rows.mapInArrow(_count(gram), "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _probes(hashes: np.ndarray, slots: int, probes: int) -> Iterator[np.ndarray]:
    for _ in range(probes):
        yield (hashes >> np.uint64(20)).astype(np.int64) & (slots - 1)
        hashes = hashes * _MIX
        hashes = hashes ^ (hashes >> np.uint64(32))


@dataclass(frozen=True)
class LanguageFilter:
    """The slots and how often each language's bits lie.

    ``slots`` has a row of bitmasks for every ``MASK_BITS`` languages, as narrow as they allow.
    """

    languages: tuple[str, ...]
    slots: np.ndarray
    probes: int
    gram: int

    def false_share(self) -> np.ndarray:
        """Chance that a gram of no language passes a language's filter."""
        each = [np.mean((self.slots[k // MASK_BITS] >> k % MASK_BITS) & 1) for k in range(len(self.languages))]
        return np.array(each) ** self.probes

    def languages_of(self, hashes: np.ndarray, group: int = 0) -> np.ndarray:
        """Bitmask of all languages (of one group of ``MASK_BITS``) that contain each gram."""
        slots = self.slots[group]
        masks = np.full(len(hashes), -1, dtype=slots.dtype)
        for place in _probes(hashes, len(slots), self.probes):
            masks &= slots[place]
        return masks

    def predict(self, texts: list[str], false_share: np.ndarray, letters: np.ndarray) -> tuple[list[str], list[float]]:
        """Language and score of each text.

        A language's popcount is corrected for the grams that pass by chance; the largest share
        decides, the first language in order of name among equal ones.  A text with letters but
        without a gram of any language has a share of zero in all: it gets the first one too, with
        score zero.
        """
        hashes, owner = gram_hashes(texts, self.gram, letters)
        total = np.bincount(owner, minlength=len(texts)).astype(float)
        if not self.languages or not len(hashes):
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        shares = np.zeros((len(self.languages), len(texts)))
        for k, by_chance in enumerate(false_share):
            if k % MASK_BITS == 0:
                masks = self.languages_of(hashes, k // MASK_BITS)
            hits = np.bincount(owner, weights=(masks >> k % MASK_BITS) & 1, minlength=len(texts))
            own = (hits - total * by_chance) / max(1e-9, 1 - by_chance)
            shares[k] = np.clip(own / np.maximum(total, 1), 0, 1)
        best = shares.argmax(axis=0)
        some = total > 0
        names = [self.languages[b] if s else UNKNOWN for b, s in zip(best, some)]
        return names, np.where(some, shares.max(axis=0), 0.0).tolist()


def _fill(slots: int, probes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, masks = batch.column("gram").to_numpy().view(np.uint64), batch.column("mask")
            for place in _probes(hashes, slots, probes):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("part"), pa.array(place), masks], ["part", "slot", "mask"]
                )

    return run


def learn(
    labelled: DataFrame, *, gram: int = GRAM, slots: int = SLOTS, probes: int = PROBES, least_part: float = LEAST_PART
) -> LanguageFilter:
    """Fit the filter on all rows of ``lang, text``.

    Every gram that stands out in a language against the others is kept, however rare it is.
    Counting and filling run on Spark; the driver gets the languages and the filled slots: at least
    ``slots``, and ``SLOTS_EACH`` for every gram, of a byte each for up to seven languages and of
    eight for every 63.
    """
    counts = pin(gram_counts(labelled, gram), "grams")
    every = Window.partitionBy("gram")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    languages = tuple(r.lang for r in totals.select("lang").orderBy("lang").collect())
    narrow = [t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).bits > min(len(languages), MASK_BITS)]
    groups = max(1, -(-len(languages) // MASK_BITS))
    if not languages:
        return LanguageFilter(languages, np.zeros((groups, slots), dtype=narrow[0]), probes, gram)
    share = counts.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total"))
    top = share.withColumn("top", F.max("share").over(every))
    kept = top.filter(F.col("share") >= least_part * F.col("top"))
    order = F.array(*[F.lit(x) for x in languages])
    number = F.array_position(order, F.col("lang")).cast("int") - 1
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("number") % MASK_BITS)
    kept = kept.select("gram", number.alias("number")).withColumn("part", F.floor(F.col("number") / MASK_BITS).cast("int"))
    masks = pin(kept.groupBy("gram", "part").agg(F.bit_or(bit).alias("mask")), "masks")
    # The most grams of one part of the languages decide, as each part has its own masks.
    most = masks.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    while slots < SLOTS_EACH * most:
        slots *= 2
    table = np.zeros((groups, slots), dtype=narrow[0])
    filled = masks.mapInArrow(_fill(slots, probes), "part int, slot long, mask long")
    filled = filled.groupBy("part", "slot").agg(F.bit_or("mask").alias("mask"))
    rows = filled.select("part", F.col("slot").cast("int").alias("slot"), "mask").toArrow()
    table[rows["part"].to_numpy(), rows["slot"].to_numpy()] = rows["mask"].to_numpy().astype(table.dtype)
    return LanguageFilter(languages, table, probes, gram)


def identify(
    docs: DataFrame, model: LanguageFilter, *, key: str = "doc_id", text: str = "text", carry: bool = False
) -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text; ``und`` and 0 for null or letterless ones.

    With ``carry`` the whole input row comes along as a struct ``row``, in place of the key.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.slots, model.false_share()))
    languages, probes, gram = model.languages, model.probes, model.gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (slots, false_share), letters = shared.value, letter_table()
        own = LanguageFilter(languages, slots, probes, gram)
        for batch in (whole.slice(at, _ROWS) for whole in batches for at in range(0, whole.num_rows, _ROWS)):
            names, scores = [], []
            column = batch.column("row").field(text) if carry else batch.column("text")
            for _, texts in _grouped([pa.RecordBatch.from_arrays([column], ["text"])]):
                some_names, some_scores = own.predict(texts, false_share, letters)
                names += some_names
                scores += some_scores
            others = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in others), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [*others, "lang_pred", "score"],
            )

    # A carried row holds the text already; it does not travel twice.
    rows = docs.select(*carried(docs, carry)) if carry else keyed_text(docs, key, text)
    schema = f"{carried_type(rows) or 'doc_id long, '}lang_pred string, score double"
    return rows.mapInArrow(run, schema)
