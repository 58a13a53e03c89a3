"""Delimited files read in splits against the parser of whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.sources import delimited

PIECES = ['"', '""', ",", ";", "\n", "\r\n", "\r", "a", "bc", " ", "é", '"x"', '"a,b"', '"l\n1"', ",,", "\n\n"]


def whole(spark, texts):
    docs = spark.createDataFrame(texts, "path string, value string")
    rows = delimited.delimited_rows(docs, "path", "value", F.regexp_extract("path", r"\.(\w+)$", 1)).collect()
    return sorted((r.path, r.delimiter, r.row_no, tuple(r.cells)) for r in rows)


def in_splits(spark, folder):
    rows = delimited.scan_delimited(spark, str(folder)).collect()
    return sorted((r.path.rsplit("/", 1)[1], r.delimiter, r.row_no, tuple(r.cells)) for r in rows)


@pytest.fixture(params=["40b", "1k", "128m"])
def splits(spark, request):
    names = {"spark.sql.files.maxPartitionBytes": request.param, "spark.sql.files.openCostInBytes": "1b", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_splits_equal_the_whole(spark, tmp_path, splits):
    rng = random.Random(17)
    texts = [(f"f{k}.{rng.choice(['csv', 'tsv', 'psv', 'txt'])}", "".join(rng.choices(PIECES, k=rng.randint(1, 120)))) for k in range(25)]
    texts += [
        ("open.csv", 'a,b\n1,"never\n' + "x,y\n" * 60), ("long.csv", "h,i\n" + "".join(f'{k},"l{k}\n""q""\n"\n' for k in range(80))),
        ("wide.csv", "a\n1,2,3\n\n4"), ("blank.csv", "\n\r\n\n"), ("cr.csv", "a,b\r1,2\r\"x\r\ny\",3"), ("stray.csv", 'a,b\n5" pipe,"in"out",x"\n"z'),
    ]
    for name, text in texts:
        (tmp_path / name).write_bytes(text.encode())
    assert in_splits(spark, tmp_path) == whole(spark, texts)


def test_a_large_file_uses_several_tasks(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        (tmp_path / "big.csv").write_text("id,text\n" + "".join(f'{k},"line\n{k}, ""{k % 7}"""\n' for k in range(60_000)))
        assert delimited._lines(spark, str(tmp_path)).rdd.getNumPartitions() >= 8
        rows = delimited.scan_delimited(spark, str(tmp_path)).filter("row_no > 0")
        told = rows.agg(
            F.count("*"), F.max("row_no"), F.count_if(F.col("cells")[1] == F.concat(F.lit("line\n"), F.col("cells")[0], F.lit(', "'), (F.col("cells")[0].cast("int") % 7).cast("string"), F.lit('"'))),
            F.count_if(F.col("cells")[0].cast("int") == F.col("row_no") - 1),
        ).first()
        assert tuple(told) == (60_000,) * 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_text_is_parsed_once(spark):
    docs = spark.createDataFrame([(1, "a,b\n1\n2,3"), (2, None), (3, "")], "k int, t string")
    rows = delimited.delimited_rows(docs, "k", "t")
    assert [(r.k, r.row_no, r.cells) for r in rows.orderBy("row_no").collect()] == [(1, 0, ["a", "b"]), (1, 1, ["1", ""]), (1, 2, ["2", "3"])]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Filter" in line and "regexp" in line]
