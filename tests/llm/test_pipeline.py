"""The pipeline's stages and what each must drop and keep."""

import random

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline

SF_DIR = "/root/testdata/sf0.001"


def test_stages_hand_on_the_columns_of_documents(spark, odd, empty):
    for frame in (odd.select("doc_id", "text", "lang", "source", "n_chars"), empty.select("doc_id", "text", "lang", "source", "n_chars")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, SF_DIR)
            assert [f.name for f in frame.schema] == ["doc_id", "text", "lang", "source", "n_chars"]
            frame = spark.createDataFrame(frame.collect(), frame.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, frame, SF_DIR).count() == frame.count()


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(8)
    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    syllables = "ba ke li mo nu ra se ti vo".split()

    def prose(words):
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(words))

    shared, base = prose(60), prose(300)
    texts = [prose(200) for _ in range(30)]
    special = {
        100: base, 101: base, 102: base.replace(base.split()[150], "other", 1), 103: "!!! ??? 123", 104: prose(50) + " " + items[0] + " " + prose(50),
        105: prose(80) + "\n" + shared + "\n" + prose(80), 106: prose(80) + "\n" + shared + "\n" + prose(80), 107: None,
    }
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)] + [(k, t, "en", "s", len(t or "")) for k, t in special.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), shared


def test_planted_cases(spark, planted):
    docs, shared = planted
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF_DIR).collect(), docs.schema)
        kept[name] = {r.doc_id: r for r in docs.collect()}
    language, near, cut, clean = kept.values()
    assert set(range(30)) <= set(clean)
    assert not {103, 107} & set(language) and {100, 101, 102} <= set(language)
    assert {100, 101, 102} & set(near) == {100}
    assert shared in cut[105].text and shared not in cut[106].text and cut[106].n_chars == len(cut[106].text)
    assert 104 in cut and 104 not in clean
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for row in corpus_pipeline.tokens(spark, docs, SF_DIR).collect():
        assert list(row.ids) == library.encode(clean[row.doc_id].text)
