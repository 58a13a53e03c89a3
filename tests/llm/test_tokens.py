"""SentencePiece rounds and plane files against the libraries themselves."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shelfmark.llm import pieces, planes

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.mark.parametrize("letters", ["abcde", "ab ", "a▁ ", "thein ra", " \n\t", "é日🙂a ", "01 .", "<s>0x", "x=\u0000"])
def test_pieces_equal_the_library(library, letters):
    rng = random.Random(letters)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 70))) for _ in range(400)]
    for text, (n, digits, plain, ids) in zip(texts, pieces.Encoder(PIECES).encode(texts)):
        expected = library.encode(text)
        assert ids.tolist() == expected and n == len(expected)
        assert digits.decode() == ",".join(map(str, expected))
        assert plain.decode() == library.decode(expected)


def test_long_words_and_a_small_memory(library):
    texts = ["ab" * 2000, "=" * 999, " " * 500, "a" * 4001, "é" * 300, "plain words here"]
    encoder = pieces.Encoder(PIECES, remembered=2)
    for _ in range(2):
        assert [x[3].tolist() for x in encoder.encode(texts)] == [library.encode(t) for t in texts]


def test_pieces_of_odd_rows(library, odd, odd_rows, empty):
    got = pieces.encode_documents(odd, PIECES, with_ids=True).collect()
    assert sorted(map(str, (r.ids for r in got))) == sorted(str(library.encode(r[1] or "")) for r in odd_rows)
    assert sorted(r.decoded for r in got) == sorted(library.decode(library.encode(r[1] or "")) for r in odd_rows)
    assert pieces.encode_documents(empty, PIECES).count() == 0


def test_texts_are_decoded_from_their_ids(library, monkeypatch):
    monkeypatch.setattr(pieces, "DECODED", 3)
    texts = ["many plain words in a row", "  two  spaces ", "日本 é\u0000 x", "longwordwithoutanyspaceinit", "a" * 50, ""]
    encoder = pieces.Encoder(PIECES)
    assert [x[2].decode() for x in encoder.encode(texts)] == [library.decode(library.encode(t)) for t in texts]
    # Other ids of the words that were met give another text: nothing is copied from the input.
    other = library.encode("other")
    encoder.known[" many"] = len(other), ",".join(map(str, other)).encode(), np.array(other, dtype=np.int32).tobytes()
    assert next(encoder.encode(texts[:1]))[2].decode() == "other plain words in a row"


@pytest.mark.parametrize("kind", [b"B", b"b"])
@pytest.mark.parametrize("count", [0, 1, 7, 64, 1000])
def test_planes_round_trip(kind, count):
    ids = np.random.default_rng(count).integers(0, 2**32, count, dtype=np.uint32)
    data = planes.pack(ids, kind, block_ids=64)
    assert (planes.unpack(data) == ids).all()
    assert (planes.unpack(data, 2, 3) == ids[128 : 128 + 192]).all()


def test_a_foreign_file_is_refused():
    with pytest.raises(ValueError):
        planes.unpack(b"\0" * 40)


@pytest.mark.parametrize("kind", [b"B", b"b"])
def test_token_files(spark, odd, odd_rows, tmp_path, kind):
    path = str(tmp_path / "tokens")
    planes.write_tokens(odd, WORDS, path, kind=kind, segment_ids=500)
    got = planes.read_tokens(spark, path).orderBy("start").collect()
    encode, start = Tokenizer.from_file(WORDS).encode, 0
    ordered = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert len(got) == len(ordered)
    for row, (doc_id, text, *_) in zip(got, ordered):
        ids = encode(text or "", add_special_tokens=False).ids + [2]
        assert (row.doc_id, row.start, row.n_tokens) == (doc_id, start, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)


def test_token_files_of_no_rows(spark, empty, tmp_path):
    path = str(tmp_path / "none")
    planes.write_tokens(empty, WORDS, path)
    assert planes.read_tokens(spark, path).count() == 0


def test_batches_are_taken_a_group_at_a_time():
    taken = []
    texts = (taken.append(k) or "x" * 1000 for k in range(5000))
    assert len(next(pieces._grouped(texts))) == len(taken) < 1000


def test_decoded_texts_leave_a_task_only_if_wanted(spark, library):
    docs = spark.createDataFrame([(1, "plain words"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in pieces.encode_documents(docs, PIECES, with_ids=True, with_decoded=False).collect()}
    assert got[1].ids == library.encode("plain words") and got[2].n_tokens == 0 and "decoded" not in got[1]
