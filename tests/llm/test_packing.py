"""Packed sequences: every id once, no padding, few cuts."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfmark.llm import bytebpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("special", [True, False])
def test_ids_equal_the_library(special):
    library, own = Tokenizer.from_file(PATH), bytebpe.ByteTokens(PATH, special)
    library.encode_special_tokens = not special
    rng = random.Random(1)
    parts = ["the", " the", "  ", "\n", " \n", "\t", "don't", "'S", "é", "日本", "🙂", "<|endoftext|>", "<|", "12", "!?", " ", "\u0000", " x", "ǅ"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(1500)] + [" " * 5000 + "a", "x" * 5000]
    for text in texts:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
        cut = list(bytebpe.blocks(text, 5))
        assert "".join(cut) == text
        assert np.concatenate([own.encode_block(b) for b in cut]).tolist() == library.encode(text, add_special_tokens=False).ids


def test_another_kind_of_vocabulary_is_refused():
    with pytest.raises(ValueError):
        bytebpe.ByteTokens(public_tokenizers.path("word_bpe_49k.json"))


def check(rows, texts, library, length):
    """Whether pieces cover every document once and sequences are full; returns their number."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length > 0 and len(r.ids) == 4 * r.length
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        ids = library.encode(texts[doc_id] or "", add_special_tokens=False).ids + [0]
        assert b"".join(r.ids for r in pieces) == np.array(ids, dtype="<u4").tobytes()
        at = 0
        for r in pieces:
            assert r.start == at and r.doc_tokens == len(ids)
            at += r.length
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == length or at & (at - 1) == 0 and at < length
    return len(by_sequence)


@pytest.mark.parametrize("length, windows", [(1024, 64), (100, 3), (7, 1), (64, 1000)])
def test_every_id_once(spark, library, length, windows):
    rng = random.Random(length)
    texts = {k: " ".join(rng.choices(["alpha", "beta", "Ö", "9"], k=int(rng.paretovariate(0.8)) % 3000)) for k in range(120)}
    texts |= {200: None, 201: "", 202: "<|endoftext|> end"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    packed = packing.pack(docs, PATH, length=length, open_windows=windows)
    count = check(packed.collect(), texts, library, length)
    total = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts.values())
    assert count <= total // length + length.bit_length()


def test_best_fit_and_the_fullest_leaves():
    windows = packing.Windows(10, 2)
    ids = lambda n: (n, 0, np.arange(n), n)
    left = lambda: [[len(p[2]) for p in w] for w in windows.left()]
    assert not list(windows.place(ids(6))) and not list(windows.place(ids(5)))
    assert not list(windows.place(ids(4 - 1))) and left() == [[6, 3], [5]]
    # Seven ids fit nowhere: one fills the fullest window, which leaves.
    (filled,) = windows.place(ids(7))
    assert [len(p[2]) for p in filled] == [6, 3, 1] and left() == [[5], [6]]
    assert [[len(p[2]) for p in w] for w in windows.place(ids(25))] == [[10], [10], [5, 5]] and left() == [[6]]


@pytest.mark.parametrize("total", [0, 1, 10, 24, 1024, 2047, 5000])
def test_last_ids_are_cut_into_powers_of_two(total):
    cuts = packing._tail_cuts(total, 1024)
    sizes = [b - a for a, b in zip(cuts, cuts[1:])]
    assert cuts[0] == total // 1024 * 1024 and cuts[-1] == total
    assert all(s & (s - 1) == 0 for s in sizes) and sizes == sorted(set(sizes), reverse=True)


def test_odd_rows(spark, library, odd, odd_rows, empty):
    rows = packing.pack(odd, PATH, length=256).collect()
    encode = lambda t: library.encode(t or "", add_special_tokens=False).ids + [0]
    assert sum(r.length for r in rows) == sum(len(encode(r[1])) for r in odd_rows)
    single = {r[0]: r[1] for r in odd_rows if sum(x[0] == r[0] for x in odd_rows) == 1}
    for doc_id, text in single.items():
        own = sorted((r.start, bytes(r.ids)) for r in rows if r.doc_id == doc_id)
        assert b"".join(i for _, i in own) == np.array(encode(text), dtype="<u4").tobytes()
    assert packing.pack(empty, PATH).count() == 0


def test_sequences_hold_their_pieces(spark, odd):
    packed = packing.pack(odd, PATH, length=128)
    rows = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert sum(r.n_tokens for r in rows.values()) * 4 == sum(len(r.ids) for r in rows.values())
    for piece in packed.collect():
        own = rows[piece.sequence_id].ids[4 * piece.offset : 4 * (piece.offset + piece.length)]
        assert zlib.crc32(own) == zlib.crc32(piece.ids)
