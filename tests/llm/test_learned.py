"""Language identification, quality classifier and outlier rules."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import langid, quality, rules

SYLLABLES = {"aa": "ba be bi bo bu".split(), "bb": "ké kü ka ko ki".split(), "cc": "bo ka zu zi wo".split()}


def sentence(rng, lang, words=40):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    made = [(k, sentence(rng, lang), lang) for k, lang in enumerate(rng.choices(list(SYLLABLES), k=300))]
    return spark.createDataFrame(made, "doc_id long, text string, lang string")


def test_languages(labelled):
    model = langid.learn(labelled.filter("doc_id % 4 <> 2"), slots=1 << 14)
    assert model.languages == ("aa", "bb", "cc")
    got = langid.identify(labelled, model).join(labelled, "doc_id").filter("doc_id % 4 = 2")
    assert got.filter("lang <> lang_pred").count() == 0 and got.filter("score NOT BETWEEN 0 AND 1").count() == 0


def test_the_filter_returns_every_language_of_a_gram(spark):
    both = spark.createDataFrame([("x", "same"), ("y", "same"), ("z", "else")], "lang string, text string")
    model = langid.learn(both, slots=1 << 12)
    hashes, _ = langid.gram_hashes(["same"], langid.GRAM, langid.letter_table())
    assert {int(m) & 7 for m in model.languages_of(hashes)} == {0b011}


def test_languages_of_odd_rows(spark, odd, empty):
    model = langid.learn(odd.select("lang", "text"), slots=1 << 14)
    got = langid.identify(odd, model, carry=True)
    assert got.select("row.*").columns == odd.columns and got.count() == odd.count()
    none = got.filter(F.col("row.text").isNull() | ~F.col("row.text").rlike(r"\p{L}"))
    assert none.count() > 0 and none.filter("lang_pred <> 'und' OR score <> 0").count() == 0
    assert got.filter("lang_pred = 'und'").count() == none.count()
    assert langid.identify(empty, model).count() == 0
    untaught = langid.learn(empty.select("lang", "text"), slots=1 << 10)
    assert langid.identify(odd, untaught).filter("lang_pred <> 'und'").count() == 0


def test_features_do_not_depend_on_neighbours():
    texts = [b"", b"a a a b", b"x, y! x", "é ü".encode(), b"   "]
    together, owner = quality.features(texts)
    for k, text in enumerate(texts):
        assert sorted(together[owner == k]) == sorted(quality.features([text])[0])


def test_classifier_on_held_out_rows(spark, odd, empty):
    rng = random.Random(2)
    good = [(k, sentence(rng, "aa"), 1) for k in range(0, 200, 2)]
    bad = [(k, " ".join(w + "$$" for w in sentence(rng, "aa").split()), 0) for k in range(1, 200, 2)]
    made = spark.createDataFrame(good + bad, "doc_id long, text string, label int")
    weights = quality.fit(made, made.filter("doc_id % 5 <> 0").select("doc_id", "label"), sample_rows=120)
    got = quality.score(made, weights).join(made.select("doc_id", "label"), "doc_id").filter("doc_id % 5 = 0")
    assert got.filter((F.col("score") >= 0.5).cast("int") != F.col("label")).count() == 0
    again = quality.fit(made.repartition(7), made.filter("doc_id % 5 <> 0").select("doc_id", "label"), sample_rows=120)
    assert (weights == again).all()
    scored = quality.score(odd, weights)
    assert scored.count() == odd.count() and scored.filter("score IS NULL OR score NOT BETWEEN 0 AND 1").count() == 0
    assert quality.score(empty, weights).count() == 0
    untaught = quality.fit(empty, empty.select("doc_id", F.lit(1).alias("label")))
    assert not untaught.any()


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times, repeated = Counter(windows), set()
    for k, w in enumerate(windows):
        if times[w] > 1:
            repeated.update(range(k, k + 5))
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines), len(lines) - len(set(lines)), len(repeated)


def test_counts_equal_brute_force(odd, odd_rows, empty):
    got = rules.text_statistics(odd).drop("doc_id").collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_counts(r[1]) for r in odd_rows)
    assert rules.text_statistics(empty).count() == 0


def test_factor_and_distance_equal_numpy(spark):
    rng = np.random.default_rng(4)
    names = list(rules.FLOORS)
    mixed = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4))
    frame = spark.createDataFrame([(1, *map(float, v)) for v in mixed], ["cell", *names])
    factors = rules._factor(rules._moments(frame, names), names, 1.0)
    got = [r.d2 for r in rules._with_distance(frame, factors, names).collect()]
    cov = np.cov(mixed.T, bias=True) + np.diag([rules.FLOORS[n] ** 2 for n in names])
    apart = mixed - mixed.mean(axis=0)
    assert np.allclose(sorted(got), sorted(np.einsum("ij,jk,ik->i", apart, np.linalg.inv(cov), apart)))


def test_outliers_do_not_hide_each_other(spark):
    rng = np.random.default_rng(5)
    names = list(rules.FLOORS)
    inner, outer = rng.normal(size=(400, 4)), rng.normal(size=(90, 4)) * 0.1 + 8
    frame = spark.createDataFrame([(1, *map(float, v)) for v in np.vstack([inner, outer])], ["cell", *names])
    got = rules._with_distance(frame, rules.robust_factors(frame, names), names).toPandas()
    far = got[names[0]] > 5
    assert (got.d2[far] > rules.CUTOFF).all() and (got.d2[~far] <= rules.CUTOFF).mean() > 0.97


def test_verdicts_of_odd_rows(odd, odd_rows, empty):
    got = rules.judge(odd).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and (r.kept is False if failed else r.kept is not None)
    assert rules.judge(empty).count() == 0


def test_a_large_alphabet_keeps_its_grams(spark):
    rng = random.Random(11)
    texts = ["".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(2000)) for _ in range(80)]
    rows = [("zh", t) for t in texts] + [("aa", sentence(rng, "aa")) for _ in range(20)]
    labelled = spark.createDataFrame(rows, "lang string, text string")
    # 160,000 grams of one language, each of them a share of 0.000006.
    model = langid.learn(labelled)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert langid.identify(docs, model).filter("lang_pred <> 'zh' OR score < 0.9").count() == 0


def test_a_filter_grows_with_its_grams(spark):
    rng = random.Random(12)
    labelled = spark.createDataFrame([("aa", sentence(rng, "aa", 4000))], "lang string, text string")
    model = langid.learn(labelled, slots=1 << 4)
    grams = np.unique(langid.gram_hashes([labelled.first().text], langid.GRAM, langid.letter_table())[0])
    assert model.slots.shape[1] >= langid.SLOTS_EACH * len(grams) and model.false_share()[0] < 0.2


@pytest.mark.parametrize("many", [63, 64, 130])
def test_any_number_of_languages(spark, many):
    rows = [(k, f"l{k:03d}", "".join(chr(0x4E00 + 100 * k + j) for j in range(60))) for k in range(many)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.learn(docs.select("lang", "text"))
    got = langid.identify(docs, model).join(docs, "doc_id")
    assert len(model.languages) == many
    assert got.filter("lang_pred <> lang OR score < 0.9").count() == 0
