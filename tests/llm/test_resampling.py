"""Importance resampling against a plain walk over all documents."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest):
    words = WORD.findall((text or "").translate(UPPER))
    return len(words), [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def brute(rows, target, percent, least, buckets, longest, seed):
    own = [(d, *features(t, longest)) for d, t in rows]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, _, found in own:
        for f in found:
            s[bucket(f)] += 1
    for text in target:
        for f in features(text, longest)[1]:
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for d, words, found in own:
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = able[: percent * len(able) // 100]
    result = [(r[0], *r[2:], k + 1) for k, r in enumerate(drawn)]
    for r in drawn:
        out.remove(r)
    return sorted(map(str, result + [(r[0], *r[2:], None) for r in out]))


def told(frame):
    return sorted(str((r.doc_id, r.n_features, r.weight, r.score, r.rank)) for r in frame.collect())


@pytest.mark.parametrize("longest, percent, least", [(1, 10, 20), (2, 50, 3), (3, 100, 0), (1, 0, 20)])
def test_equals_the_walk(spark, longest, percent, least):
    rng = random.Random(longest)
    words = "the of and Öl ÜBER naïve 日本 x9 9 don't A".split()
    rows = [(rng.randint(0, 200), " ".join(rng.choices(words, k=rng.randint(0, 60)))) for _ in range(300)]
    target = [" ".join(rng.choices(words[:4], k=30)) for _ in range(5)] + [None]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(docs, goal, percent=percent, least_words=least, buckets=50, longest=longest)
    assert told(got) == brute(rows, target, percent, least, 50, longest, 2024)


def test_odd_rows(spark, odd, odd_rows, empty):
    rows = [(r[0], r[1]) for r in odd_rows]
    got = resample.resample(odd, odd.limit(2), percent=50)
    assert told(got) == brute(rows, [r[1] for r in odd_rows[:2]], 50, 20, 10_000, 1, 2024)
    assert told(resample.resample(odd, empty)) == brute(rows, [], 10, 20, 10_000, 1, 2024)
    assert resample.resample(empty, odd).count() == 0


def test_long_texts_are_cut_between_words(monkeypatch):
    text = ("Alpha beta, gamma-δέλτα " * 50 + "x" * 300).encode()
    whole = [w for words in resample.word_blocks(text) for w in words]
    for size in (1, 7, 64, 1000):
        assert [w for words in resample.word_blocks(text, size) for w in words] == whole
    monkeypatch.setattr(resample, "word_blocks", lambda t: iter([whole[:3], whole[3:5], [], whole[5:]]))
    blocks = [b for _, found in resample.Features(97, 3).of(text) for b in found.tolist()]
    assert sorted(blocks) == sorted(zlib.crc32(f.encode()) % 97 for f in features(text.decode(), 3)[1])


@pytest.mark.parametrize("kind", ["random", "equal", "falling", "one partition"])
def test_cutoff_is_the_exact_key(spark, kind):
    rng = np.random.default_rng(5)
    high = {"random": rng.integers(-50, 50, 3000), "equal": np.zeros(3000, int), "falling": -np.arange(3000), "one partition": rng.integers(0, 9, 3000)}[kind]
    rows = [(int(h), 0, int(d), 1, k) for k, (h, d) in enumerate(zip(high, rng.integers(0, 40, 3000)))]
    keys = spark.createDataFrame(rows, "high long, none long, doc_id long, n_features long, tie long")
    keys = keys.coalesce(1) if kind == "one partition" else keys.repartition(6, F.col("tie") % 3)
    for wanted in (1, 2, 1499, 3000):
        assert resample.cutoff(keys, wanted) == sorted(rows)[wanted - 1]
    assert resample.cutoff(keys, 0) is None and resample.cutoff(keys.limit(0), 3) is None


def test_the_draw_leans_to_the_target(spark):
    rng = random.Random(3)
    near, far = "medicine doctor nurse".split(), "engine wheel road".split()
    rows = [(k, " ".join(rng.choices(near if k % 4 == 0 else far, k=40))) for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    goal = spark.createDataFrame([("doctor nurse medicine",)] * 20, "text string")
    drawn = resample.resample(docs, goal).filter("rank IS NOT NULL").collect()
    assert len(drawn) == 80 and sum(r.doc_id % 4 == 0 for r in drawn) >= 70
