"""Searching for a table of terms, and heads of files."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import documents as D
from shelfmark.sources import files

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, terms):
    out = set()
    for key, text in docs:
        if text is None:
            continue
        folded = text.translate(UPPER).encode()
        for term in {t for t in terms if t}:
            needle, at, hits = term.translate(UPPER).encode(), 0, []
            while (at := folded.find(needle, at)) >= 0:
                hits.append(at)
                at += len(needle)
            if hits:
                out.add((key, term, tuple(hits)))
    return out


def found(spark, docs, terms, **options):
    frame = spark.createDataFrame(docs, "k int, t string")
    table = spark.createDataFrame([(t,) for t in terms], "w string")
    return {(r.k, r.term, tuple(r.hits)) for r in D.doc_hits(frame, "k", "t", table, "w", **options).collect()}


def test_many_terms_equal_looking_for_each(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    docs = [(k, " ".join(word().capitalize() if rng.random() < 0.2 else word() for _ in range(150))) for k in range(60)]
    docs += [(60, None), (61, ""), (5, "same key ABCDE abcdeabcde"), (62, "🙂🙂 a\\E.b (x"), (None, "abcde null key")]
    terms = [word() for _ in range(20_000)] + ["", None, "🙂", "a\\E.b", "(x", "🙂🙂 a\\E.b", "null KEY", "ABCDE", "abcde", "aaaa"]
    assert found(spark, docs, terms) == brute(docs, terms)


def test_no_terms_or_no_documents(spark):
    assert found(spark, [(1, "some text")], ["", None]) == set()
    assert found(spark, [], ["text"]) == set()


def test_search_by_table_numbers_hits(spark):
    docs = spark.createDataFrame([(1, "ab AB xab"), (2, "none")], "d int, t string")
    terms = spark.createDataFrame([("ab",), ("zz",)], "term string")
    rows = D.doc_search(docs, "d", "t", terms).orderBy("rank").collect()
    assert [(r.label, r.offset, r.next_offset, r.previous_offset) for r in rows] == [("1/3", 0, 3, 7), ("2/3", 3, 7, 0), ("3/3", 7, 0, 3)]


def test_a_text_is_cut_once_whatever_the_terms(spark):
    docs = spark.createDataFrame([(1, "text")], "k int, t string")
    for count in (10, 5000):
        terms = spark.range(count).select(F.concat(F.lit("term"), F.col("id").cast("string")).alias("term"))
        plan = D.doc_hits(docs, "k", "t", terms)._jdf.queryExecution().optimizedPlan().toString()
        assert "(?=(.{5}))" in plan and "term12" not in plan
        assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.fixture()
def folder(tmp_path):
    for name, size in (("a.png", 10), ("b c%20ü.png", 5000)):
        (tmp_path / name).write_bytes(bytes(range(256)) * (size // 256) + bytes(size % 256))
    return tmp_path


def test_heads_are_read_without_the_file(spark, folder):
    listed = files.scan_files(spark, [str(folder)])
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.read_heads(listed, 64).collect()}
    assert set(rows) == {"a.png", "b c%20ü.png"}
    for name, row in rows.items():
        data = (folder / name).read_bytes()
        assert bytes(row["head"]) == data[:64] and row["was_longer"] == (len(data) > 64) and row["length"] == len(data)


def test_heads_of_what_is_not_there(spark, folder):
    paths = spark.createDataFrame([(str(folder / "gone"), 1), (None, 2), (str(folder / "a.png"), 3)], "path string, head int")
    rows = {r.path: (r["head"], r["was_longer"]) for r in files.read_heads(paths, 4).collect()}
    assert rows[None] == (None, None) and rows[str(folder / "gone")] == (None, None)
    assert bytes(rows[str(folder / "a.png")][0]) == bytes(4)
    assert files.read_heads(paths.limit(0), 4).count() == 0


def test_only_so_many_bytes_are_read(spark, tmp_path):
    # A sparse file of a terabyte: reading it whole would never end.
    with open(tmp_path / "big.png", "wb") as file:
        file.write(b"head")
        file.truncate(1 << 40)
    rows = files.read_heads(files.scan_files(spark, [str(tmp_path)]), 16).collect()
    assert [(bytes(r["head"]), r["was_longer"]) for r in rows] == [(b"head" + bytes(12), True)]


def test_a_table_of_terms_is_looked_up_in_batches(spark):
    docs = spark.createDataFrame([(1, "text " * 400_000 + "tëxtwörter")], "k int, t string")
    terms = spark.createDataFrame([("text",), ("tëxtwörter",), ("e",)], "term string")
    found = {r.term: r.hits for r in D.doc_hits(docs, "k", "t", terms).collect()}
    assert found["text"] == list(range(0, 2_000_000, 5)) and found["tëxtwörter"] == [2_000_000]
    assert len(found["e"]) == 400_001
    # No pattern is made for each document and term.
    plan = D.doc_hits(docs, "k", "t", terms)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan.lower()
