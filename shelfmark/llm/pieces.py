"""SentencePiece BPE, encoded in vectorised merge rounds over flat symbol arrays.

The model's normaliser is the identity with a leading space and spaces written as U+2581; no
piece has that mark behind another character, so merges never cross from one word to the next
and each distinct word of a task (letters, digits and stops apart, where no piece joins them) is merged once.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed_text

MARK = "▁"
# Words with the spaces in front of them; and the same with letters, digits and all else apart.
_WORDS = re.compile(r" *[^ ]+| +")
_LETTER = r"[^\W\d_¹²³¼½¾]"
_PARTS = re.compile(rf" *{_LETTER}+| *\d+| *(?:[^\w ]|[_¹²³¼½¾])+| +")
_KINDS = re.compile(rf"({_LETTER})|(\d)")
_NONE = np.iinfo(np.int32).max

# Bytes that a task's memory of words may take, and what an entry takes besides its ids; beyond that it starts over.
REMEMBERED = 40 << 20
_ENTRY = 320

# Ids that the library decodes at a time; longer lists are cut in front of a word.
DECODED = 1 << 18


class PairTable:
    """Which of some distinct numbers each of many is, by an open hash table."""

    _FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.numbers = np.full(1 << self.bits, -1, dtype=np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            # The first of each free slot takes it; the others go one further.
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            taken = free[first]
            self.keys[slot[taken]], self.numbers[slot[taken]] = keys[left[taken]], left[taken]
            rest = np.ones(len(left), dtype=bool)
            rest[taken] = False
            left, slot = left[rest], (slot[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self._FACTOR) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 for those that are not there."""
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.numbers[slot], -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[left]]
            same = held == keys[left]
            out[left[same]] = self.numbers[slot[left[same]]]
            left = left[~same & (held >= 0)]
        return out


class PieceModel:
    """Pieces of a SentencePiece BPE model and the merges that they allow."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        pieces = [model.id_to_piece(k) for k in range(count)]
        self.unknown = model.unk_id()
        self.bytes = {k for k in range(count) if model.is_byte(k)}
        special = {k for k in range(count) if model.is_control(k) or model.is_unknown(k)} | self.bytes
        if any(MARK in p.lstrip(MARK) for k, p in enumerate(pieces) if k not in special):
            raise ValueError("a piece crosses words; this encoder takes each word by itself")
        self.library = model
        self.byte_id = {int(pieces[k][3:5], 16): k for k in self.bytes}
        # Pieces that begin with the mark: in front of them a list of ids can be cut.
        self.begins = np.array([k not in special and p.startswith(MARK) for k, p in enumerate(pieces)])
        # Inside this class the mark is a space again.
        ids = {p.replace(MARK, " "): k for k, p in enumerate(pieces) if k not in special}
        self.letter = np.arange(-1, -0x110001, -1, dtype=np.int64)
        for p, k in ids.items():
            if len(p) == 1:
                self.letter[ord(p)] = k
        # Where no piece joins two kinds of characters, no merge does, and texts are cut between them.
        kind = lambda c: (m := _KINDS.match(c)) and m.lastindex
        mixed = any(len({kind(c) for c in p.lstrip(" ")}) > 1 for p in ids)
        self.words = (_WORDS if mixed else _PARTS).findall
        # Every split of a piece into two pieces is a merge; its rank is that of the score.
        merges = sorted(
            (ids[p[:cut]] * count + ids[p[cut:]], -model.get_score(k), k)
            for p, k in ids.items()
            for cut in range(1, len(p))
            if p[:cut] in ids and p[cut:] in ids
        )
        scores = sorted({m[1] for m in merges})
        rank = {score: n for n, score in enumerate(scores)}
        self.count = count
        self.pairs = PairTable(np.array([m[0] for m in merges], dtype=np.int64))
        # The last entry stands for a pair that makes no piece.
        self.ranks = np.array([rank[m[1]] for m in merges] + [_NONE], dtype=np.int32)
        self.results = np.array([m[2] for m in merges] + [-1], dtype=np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging each pair; a pair that makes no piece ranks last."""
        number = self.pairs.find(np.where((left >= 0) & (right >= 0), left * self.count + right, self.count * self.count))
        return self.ranks[number], self.results[number]

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word.

        All words advance together.  In a round every word finds its pair of least rank and
        merges the leftmost one, and with it the other pairs of that rank that do not overlap
        one before, unless a symbol so made could be merged again before their turn.  Words
        without a pair leave the arrays; only pairs beside a merge are looked up anew.
        """
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbols = self.letter[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        word = np.repeat(np.arange(len(words)), sizes)
        rank, result = np.full(len(symbols), _NONE, dtype=np.int32), np.full(len(symbols), -1, dtype=np.int64)
        self._look(symbols, word, rank, result, np.arange(len(symbols)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, first)
            span = np.diff(np.append(first, len(symbols)))
            if (least == _NONE).any():
                ready = np.repeat(least == _NONE, span)
                done.append((word[ready], symbols[ready]))
                live = ~ready
                symbols, word, rank, result = symbols[live], word[live], rank[live], result[live]
                if not len(symbols):
                    break
                span, least = span[least != _NONE], least[least != _NONE]
            chosen = rank == np.repeat(least, span)
            # Of neighbouring (hence overlapping) pairs every second one goes, from the left.
            at = np.flatnonzero(chosen)
            start = np.concatenate([[True], at[1:] != at[:-1] + 1])
            order = np.arange(len(at))
            at = at[(order - np.maximum.accumulate(np.where(start, order, 0))) % 2 == 0]
            leftmost = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
            at = self._safe(symbols, word, rank, result, at, leftmost)
            symbols[at] = result[at]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            symbols, word, rank, result = symbols[keep], word[keep], rank[keep], result[keep]
            at = at - np.arange(len(at))
            self._look(symbols, word, rank, result, np.concatenate([at, at[at > 0] - 1]))
        return self._listed(done, len(words))

    def _look(self, symbols, word, rank, result, at) -> None:
        """Look up the pairs that begin at these places."""
        after = np.minimum(at + 1, len(symbols) - 1)
        inside = (after > at) & (word[after] == word[at])
        rank[at], result[at] = self.rank_of(symbols[at], np.where(inside, symbols[after], -1))

    def _safe(self, symbols, word, rank, result, at, leftmost) -> np.ndarray:
        """Leftmost merges, and the further ones of words where no new pair would go first."""
        if leftmost.all():
            return at
        made, own, mine = result[at], rank[at], word[at]
        after = np.minimum(at + 2, len(symbols) - 1)
        inside = (at + 2 < len(symbols)) & (word[after] == mine)
        following, _ = self.rank_of(made, np.where(inside, symbols[after], -1))
        # The symbol before a merge is already merged itself if the two pairs touch.
        touching = np.concatenate([[False], at[1:] == at[:-1] + 2])
        before = np.maximum(at - 1, 0)
        previous = np.where(touching, np.roll(made, 1), symbols[before])
        previous = np.where((at > 0) & (word[before] == mine), previous, -1)
        preceding, _ = self.rank_of(previous, made)
        # Scores can be equal; then the pair further left goes first.
        risky = (following <= own) | (preceding <= own)
        words_at = np.cumsum(leftmost) - 1
        calm = np.bincount(words_at, weights=risky, minlength=words_at[-1] + 1) == 0
        return at[leftmost | calm[words_at]]

    def _listed(self, done: list[tuple[np.ndarray, np.ndarray]], count: int) -> list[list[int]]:
        word = np.concatenate([w for w, _ in done]) if done else np.empty(0, dtype=np.int64)
        symbol = np.concatenate([s for _, s in done]) if done else np.empty(0, dtype=np.int64)
        order = np.argsort(word, kind="stable")
        word, symbol = word[order], symbol[order]
        edges = np.searchsorted(word, np.arange(count + 1))
        missing = np.minimum.reduceat(np.append(symbol, 0), edges[:-1]) < 0 if count else []
        flat, out = symbol.tolist(), []
        for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            ids = flat[a:b]
            if missing[k]:
                ids = [x for s in ids for x in (self._spelled(-1 - s) if s < 0 else (s,))]
            out.append(ids)
        return out

    def _spelled(self, code: int) -> list[int]:
        """A character without a piece, as its UTF-8 bytes (or as unknown, without byte pieces)."""
        if not self.byte_id:
            return [self.unknown]
        return [self.byte_id[b] for b in chr(code).encode()]

    def decode(self, ids: np.ndarray) -> str:
        """What the library decodes these ids to."""
        cuts = [0]
        if len(ids) > DECODED:
            places = np.flatnonzero(self.begins[ids])
            wanted = np.searchsorted(places, np.arange(DECODED, len(ids), DECODED))
            cuts += np.unique(places[wanted[wanted < len(places)]]).tolist()
        # A part loses its first mark, which is the space between it and the part before.
        return " ".join([self.library.decode(ids[a:b].tolist()) for a, b in zip(cuts, [*cuts[1:], len(ids)])])


class Encoder:
    """Encodes texts, remembering the words it has met."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.model, self.remembered, self.held = PieceModel(path), remembered, 0
        self.known: dict[str, tuple[int, bytes, bytes]] = {}

    def learn(self, words: set[str]) -> None:
        if self.held > self.remembered:
            self.known.clear()
            self.held = 0
        new = list(words.difference(self.known))
        for word, ids in zip(new, self.model.merge(new)):
            digits, flat = ",".join(map(str, ids)).encode(), array("i", ids).tobytes()
            self.known[word] = len(ids), digits, flat
            self.held += _ENTRY + 4 * len(word) + len(digits) + len(flat)

    def encode(self, texts: list[str]) -> Iterator[tuple[int, bytes, bytes, np.ndarray]]:
        """For each text: number of ids, the ids in decimal joined by commas, the bytes decoded from the ids, the ids."""
        split = [self.model.words(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        self.learn(set().union(*split))
        known = self.known.__getitem__
        for words in split:
            parts = list(map(known, words))
            ids = np.frombuffer(b"".join([p[2] for p in parts]), dtype=np.int32)
            yield len(ids), b",".join([p[1] for p in parts]), self.model.decode(ids).encode(), ids


def encode_documents(
    docs: DataFrame, model_path: str, *, with_ids: bool = False, with_decoded: bool = True, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode every whole text and decode its ids again.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256``, unless it is not wanted ``decoded``, and, if asked
    for, ``ids`` (array of int).  A null text is empty and has no ids.  A text repeated is encoded each time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_path)
        for batch in batches:
            start = 0
            # Results leave group by group, so a batch of long texts is not held twice over.
            for group in _grouped(t.as_py() or "" for t in batch.column("text")):
                found = list(encoder.encode(group))
                columns = [
                    batch.column("doc_id").slice(start, len(group)),
                    pa.array([n for n, *_ in found], pa.int64()),
                    pa.array([hashlib.sha256(written).hexdigest() for _, written, *_ in found], pa.string()),
                    pa.array([hashlib.sha256(plain).hexdigest() for _, _, plain, _ in found], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_decoded:
                    columns.append(pa.array([plain.decode("utf-8", "replace") for _, _, plain, _ in found], pa.string()))
                    names.append("decoded")
                if with_ids:
                    columns.append(pa.array([ids for *_, ids in found], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
                start += len(group)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", decoded string" if with_decoded else "")
    return keyed_text(docs, key, text).mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def _grouped(texts: Iterable[str], limit: int = 1 << 19) -> Iterator[list[str]]:
    """Texts in groups of about ``limit`` characters; distinct words are merged a group at a time."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group
