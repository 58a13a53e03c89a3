"""Byte-level BPE ids of whole texts, with the bytes that each id stands for."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np

# The published pre-tokenisation pattern of byte-level BPE, and the bytes that stand for
# themselves in its vocabulary file (the others are written as code points from 256 on, in order).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]

# Texts are encoded in blocks of about so many characters.
BLOCK_CHARS = 1 << 20

# Longer runs of white space go to the slower library, whose matcher does not recurse over them.
_LONG_GAP = re.compile(r"\s{2000}")

# Between a character and a space in front of another word: neither this vocabulary's pattern nor a
# vocabulary of pieces that begin with their space ever joins tokens over such a place.
_CUT = re.compile(r"(?<=[^ ])(?= \S)")


def blocks(text: str, size: int = BLOCK_CHARS) -> Iterator[str]:
    """A text in blocks of at least ``size`` characters, cut where no token can cross.

    A text without such a place is one block.
    """
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class ByteTokens:
    """Ids by the vocabulary of a tokenizers file, equal to those of the tokenizers library.

    A vocabulary whose merges are numbered in their order can be read by ranks alone, which is
    several times faster; a file of any other kind is refused.  ``special`` says whether the
    strings of added tokens inside a text become those tokens or stay plain text.
    """

    def __init__(self, path: str, special: bool = True):
        import tiktoken

        self.path, self.special, self._library = path, special, None
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, before = told["model"], told["pre_tokenizer"]
        added = {t["content"] for t in told["added_tokens"]}
        hidden = (b for b in range(256) if b not in _PRINTED)
        letter = {chr(b): b for b in _PRINTED} | {chr(256 + k): b for k, b in enumerate(hidden)}
        ranks = {bytes(map(letter.__getitem__, t)): k for t, k in model["vocab"].items() if t not in added}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"]["".join(p)] for p in pairs]
        plain = before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        if told["normalizer"] or not plain or model["type"] != "BPE" or made != list(range(256, 256 + len(made))):
            raise ValueError("not a byte-level vocabulary numbered in the order of its merges")
        self.surface = [b""] * (max(max(model["vocab"].values()), *ranks.values()) + 1)
        for token, k in ranks.items():
            self.surface[k] = token
        for t in told["added_tokens"]:
            self.surface += [b""] * (t["id"] + 1 - len(self.surface))
            self.surface[t["id"]] = t["content"].encode()
        self.sizes = np.fromiter(map(len, self.surface), dtype=np.int64, count=len(self.surface))
        self._marks = re.compile("|".join(map(re.escape, added))) if special and added else None
        self._fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def library(self):
        if self._library is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.encode_special_tokens = not self.special
        return self._library

    def encode_block(self, text: str) -> np.ndarray:
        if _LONG_GAP.search(text) or (self._marks and self._marks.search(text)):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.asarray(self._fast.encode_to_numpy(text, disallowed_special=()), dtype=np.uint32)

    def encode(self, text: str) -> np.ndarray:
        return np.concatenate([self.encode_block(b) for b in blocks(text)])
