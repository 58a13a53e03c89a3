"""Token alignment against comparing every token with every other."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shelfmark.llm import alignment

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def byte_table():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def spelled(text, libraries, table=byte_table()):
    a, b = libraries
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(table[c] for c in a.id_to_token(k)) for k in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, b.id_to_piece(k)) for k in ids_b)]
    return ids_a, bytes_a, ids_b, bytes_b


def brute(rows, libraries):
    docs, held = [], Counter()
    for doc_id, text in rows:
        ids_a, bytes_a, ids_b, bytes_b = spelled(text, libraries) if text else ([], [], [], [])
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode():
            docs.append((doc_id, [], [], [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        links = [
            (x, y) for x, e, m in zip(ids_a, ends_a, bytes_a) for y, f, n in zip(ids_b, ends_b, bytes_b)
            if max(e - len(m), f - len(n)) < min(e, f)
        ]
        groups, last = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            side = lambda ids, ends: ",".join(str(k) for k, e in zip(ids, ends) if last < e <= cut)  # noqa: B023, E731
            groups.append(side(ids_a, ends_a) + "|" + side(ids_b, ends_b))
            last = cut
        docs.append((doc_id, ids_a, ids_b, links, ";".join(groups)))
        held.update(set(links))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return sorted(
        str((d, len(a), len(b), groups.count("|"), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links),
             hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
        for d, a, b, links, groups in docs
    )


def told(frame):
    return sorted(str((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in frame.collect())


def random_rows(count):
    rng = random.Random(count)
    parts = ["the ", "in", "ternational", " ", "  ", "\n", "Ö", "ß", "日本", "🙂", "don't", "12", "x", ".", "<|endoftext|>", "<s>", "▁", " ", "\u0000", " \n"]
    weights = [9] * 15 + [1] * 5
    return [(k, "".join(rng.choices(parts, weights, k=rng.randint(0, 40)))) for k in range(count)]


@pytest.mark.parametrize("pairs", [alignment.BROADCAST_PAIRS, 0])
def test_equals_comparing_everything(spark, libraries, pairs):
    rows = random_rows(150) + [(900, None), (901, ""), (901, "same id"), (902, "the the the"), (902, "the the the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = alignment.align_documents(docs, *PATHS, broadcast_pairs=pairs)
    assert told(got) == brute(rows, libraries)


def test_odd_rows(spark, libraries, odd, odd_rows, empty):
    rows = [(r[0], r[1]) for r in odd_rows if len(r[1] or "") < 4000]
    short = odd.filter("coalesce(length(text), 0) < 4000")
    assert told(alignment.align_documents(short, *PATHS)) == brute(rows, libraries)
    assert alignment.align_documents(odd, *PATHS).count() == len(odd_rows)
    for pairs in (0, 10):
        assert alignment.align_documents(empty, *PATHS, broadcast_pairs=pairs).count() == 0


def test_blocks_do_not_change_a_text(spark, libraries, monkeypatch):
    rows = random_rows(60)
    pair = alignment.Pair(*PATHS)
    for _, text in rows:
        whole, cut = alignment.Found(), alignment.Found()
        for found, size in ((whole, 1 << 20), (cut, 3)):
            coded = [pair.encode(b) for b in alignment.blocks(" " + text, size)] if text else []
            if None in coded:
                found.good = False
            else:
                for step in range(0, len(coded), 2):
                    for result in alignment.align(pair, coded[step : step + 2]):
                        found.add(*result)
        assert str(whole.row(pair.base)) == str(cut.row(pair.base))


def test_groups_as_text(spark, libraries):
    docs = spark.createDataFrame([(1, "international 日本 tokens"), (2, "a▁b")], "doc_id long, text string")
    rows = {r.doc_id: r for r in alignment.aligned(docs, *PATHS, with_groups=True).collect()}
    assert hashlib.sha256(rows[1].groups.encode()).hexdigest() == rows[1].groups_sha256
    assert rows[1].groups.count("|") == rows[1].n_groups and rows[2].n_a == 0 and rows[2].groups == ""


@pytest.mark.parametrize("lane", [1, 3, 64])
@pytest.mark.parametrize("sizes", [(0, 5), (1, 1), (5, 900), (700, 800), (64, 1), (900, 5)])
def test_gallop(lane, sizes):
    rng = np.random.default_rng(sum(sizes))
    few, many = (np.sort(rng.choice(2000, n, replace=False)) for n in sizes)
    assert alignment.gallop(few, many, lane).tolist() == np.searchsorted(many, few).tolist()
