"""Sources, sinks and streams over real files."""

import io
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from shelfmark.sources import archives, delimited, files, lines, notebooks, overview, sections, sinks
from shelfmark.sources.files import identity
from shelfmark.streaming.catalog import catalog_rescan, start_catalog
from shelfmark.streaming.versions import file_versions
from shelfmark.streaming.throttle import throttle_batch, throttle_stream


def _names(df):
    return sorted(r["path"].rsplit("/", 1)[1] for r in df.select("path").collect())


def test_scan_files(spark, tmp_path):
    for name in ("a.jpg", "b.PNG", "c.xyz", "deep/d.mp3", "deep/er/e.pdf"):
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(b"x" * 3)
    root = str(tmp_path)
    assert _names(files.scan_files(spark, [root])) == ["a.jpg", "b.PNG", "d.mp3", "e.pdf"]
    assert _names(files.scan_files(spark, [root], max_depth=1)) == ["a.jpg", "b.PNG", "d.mp3"]
    assert _names(files.scan_files(spark, [root, root], recurse=False)) == ["a.jpg", "b.PNG"]
    plan = files.scan_files(spark, [root])._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    explicit = spark.createDataFrame([("/x/y.gif",), ("/x/y.doc?",)], "path string")
    report = files.input_report(files.expand_inputs(spark, [root], explicit)).first()
    assert (report["kept"], report["skipped"]) == (3, 2)


def test_a_table_in_parts_is_one_input(spark, tmp_path):
    for name in ("one.parquet", "more.parquet/part-0.parquet", "more.parquet/part-1.parquet", "a.jpg", "v1.2/b.jpg", "deep/c.jpg"):
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(b"x")
    for root in (str(tmp_path), f"{tmp_path}/", f"file://{tmp_path}"):
        got = files.expand_inputs(spark, [root])
        assert _names(got) == ["a.jpg", "more.parquet", "one.parquet"]
        assert files.input_report(got).first().asDict() == {"kept": 1, "skipped": 2}


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n;"x;y"\r\n1;"two\nlines ""q"""\r\n\r\n3\r\n')
    (tmp_path / "b.psv").write_text("h|i\n1|2,3,4")
    (tmp_path / "c.csv").write_text("")
    rows = delimited.scan_delimited(spark, str(tmp_path)).collect()
    got = {(r["path"].rsplit("/", 1)[1], r["row_no"]): (r["delimiter"], r["cells"]) for r in rows}
    assert got == {
        ("a.csv", 0): (";", ["n", "x;y"]), ("a.csv", 1): (";", ["1", 'two\nlines "q"']), ("a.csv", 2): (";", ["3", ""]),
        ("b.psv", 0): ("|", ["h", "i"]), ("b.psv", 1): ("|", ["1", "2,3,4"]),
    }


def test_notebook(spark):
    good = (
        '{"metadata":{"language_info":{"name":"r"}},"cells":[{"cell_type":"markdown","source":"![](attachment:a)",'
        '"attachments":{"a":{"image/png":"!!"},"b":{"image/gif":"QQ=="}}},{"cell_type":"code","source":["x\\n","y"],'
        '"outputs":[{"output_type":"execute_result","data":{"text/plain":["1"]}},{"output_type":"other"}]}]}'
    )
    df = spark.createDataFrame([(1, good), (2, "{broken"), (3, '{"cells":7}')], "i int, t string")
    rows = notebooks.notebook_cells(df, "i", "t").orderBy("i", "cell").collect()
    assert [(r["i"], r["kind"], r["source"], r["outputs"], r["lang"]) for r in rows] == [
        (1, "markdown", "![](c0/attachment:a)", "", "r"), (1, "code", "x\ny", "1", "r"),
        (2, "raw-json", "{broken", "", "json"), (3, "raw-json", '{"cells":7}', "", "json"),
    ]
    pictures = notebooks.attachments(df, "i", "t").collect()
    assert [(r["name"], bytes(r["content"])) for r in pictures] == [("c0/attachment:b", b"A")]


def test_line_formats(spark, tmp_path):
    text = spark.createDataFrame([("# c",), ("",), ("a.avif 6.0 # encoder",), ("b.dds 2",), ("c.gif # why",)], "line string")
    got = [tuple(r) for r in lines.scan_baseline(text).collect()]
    assert got == [("a.avif", 6.0, "encoder", False), ("b.dds", 2.0, "", True), ("c.gif", None, "why", False)]
    runs = lines.scan_measurements(spark.createDataFrame([("x\t1.5",), ("y\tFAIL",), ("noise",)], "line string"))
    assert [tuple(r) for r in runs.collect()] == [("x", 1.5, "ok"), ("y", None, "FAIL")]
    (tmp_path / "de.toml").write_text('# c\na = "1"\n  b = "no"\na = "2 {n}"  \n')
    entries = lines.scan_locales(lines.read_lines(spark, str(tmp_path))).collect()
    assert [tuple(r) for r in entries] == [("de", 1, "a", "1"), ("de", 3, "a", "2 {n}")]


def test_archives(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("dir/", b"")
        z.writestr("z.txt", b"12345")
        z.writestr("z.txt", b"1")
        z.writestr("naïve.txt", b"x")
    raw = buffer.getvalue()
    (tmp_path / "ok.zip").write_bytes(raw)
    # The same archive with the UTF-8 flag cleared still reads as UTF-8.
    (tmp_path / "unflagged.zip").write_bytes(raw.replace(b"\x00\x08\x00\x00", b"\x00\x00\x00\x00"))
    (tmp_path / "not.zip").write_bytes(b"PK\x03\x04 broken")
    (tmp_path / "plain.txt").write_bytes(b"hello")
    rows = archives.scan_archives(spark, str(tmp_path)).orderBy("archive_id", "ord").collect()
    got = {}
    for r in rows:
        got.setdefault(r["archive_id"].rsplit("/", 1)[1], []).append((r["name"], r["is_dir"], r["size"]))
    want = [("dir/", True, 0), ("z.txt", False, 5), ("z.txt", False, 1), ("naïve.txt", False, 1)]
    assert got == {"ok.zip": want, "unflagged.zip": want}


def test_sections(spark):
    body = "- note " + "x" * 90
    md = f"top\n## 1.0\n{body}\n## 0.9  \r\n- TODO {body}\n## 0.9\nshort\n### sub\n## 0.8\n- a placeholder {body}\n## 0.7\n- [placeholder] {body}"
    rows = sections.split_sections(spark.createDataFrame([(1, md)], "i int, t string"), "i", "t").collect()
    assert [(r["heading"], r["valid"], r["unique"], r["unfilled"]) for r in rows] == [
        ("1.0", True, True, False), ("0.9", False, False, True), ("0.9", False, False, False), ("0.8", True, True, False), ("0.7", False, True, True),
    ]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b|c", 2.0), ("a", float("nan")), ("c", None)], "n string, v double")
    got = [r["json"] for r in sinks.json_rows(df).collect()]
    assert got == ['{"n":"b|c","v":2.0}', '{"n":"a","v":null}', '{"n":"c","v":null}']
    table = [r["line"] for r in sinks.gfm_table(df, ["n"], ["n", "v"], 2).orderBy("line_no").collect()]
    assert table == ["| # | n | v |", "| --- | --- | --- |", "| 1 | a | NaN |", r"| 2 | b\|c | 2.0 |", "Showing the first 2 of 3 rows."]
    with pytest.raises(sinks.DriftTooHigh):
        sinks.write_baseline(df, "n", str(tmp_path / "no"), drift=0.3)
    assert not (tmp_path / "no").exists()
    sinks.write_baseline(df.unionByName(df), "n", str(tmp_path / "yes"))
    written = "".join(p.read_text() for p in sorted((tmp_path / "yes").glob("part-*")))
    assert written.split("\n") == ["a", "b|c", "c", ""]


def test_overview(spark):
    users = spark.createDataFrame([(i, f"u{i}", bytearray(b"xyz"), 1.0) for i in range(60)], "id int, name string, blob binary, w double")
    empty = users.filter("false")
    rows = {r["table_name"]: (r["n_columns"], r["n_rows"]) for r in overview.table_summary({"users": users, "none": empty}).collect()}
    assert rows == {"users": (4, 60), "none": (4, 0)}
    first = overview.table_preview(users.withColumn("name", F.repeat("name", 100)), "id", max_chars=160).collect()
    assert len(first) == 50 and first[0]["blob"] == "(3 bytes)" and first[0]["w"] == "1.0" and len(first[0]["name"]) == 161
    users.createOrReplaceTempView("users_view")
    listed = overview.catalog_overview(spark).filter("table_name = 'users_view'").first()
    assert listed["n_rows"] == 60 and listed["views"] >= 1
    spark.catalog.dropTempView("users_view")


def test_incremental_catalog(spark, tmp_path):
    source, catalog, offsets = tmp_path / "in", str(tmp_path / "catalog"), str(tmp_path / "offsets")
    source.mkdir()
    (source / "a.bin").write_bytes(b"1")
    for _ in range(2):
        start_catalog(spark, str(source), catalog, offsets).awaitTermination()
    (source / "b.bin").write_bytes(b"22")
    start_catalog(spark, str(source), catalog, offsets).awaitTermination()
    assert _names(spark.read.parquet(catalog)) == ["a.bin", "b.bin"]
    assert catalog_rescan(spark, str(source), catalog).count() == 0
    time.sleep(1.1)
    (source / "a.bin").write_bytes(b"333")
    assert _names(catalog_rescan(spark, str(source), catalog)) == ["a.bin"]
    start_catalog(spark, str(source), catalog, offsets).awaitTermination()
    rows = spark.read.parquet(catalog).collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["length"]) for r in rows) == [("a.bin", 1), ("a.bin", 3), ("b.bin", 2)]
    assert catalog_rescan(spark, str(source), catalog).count() == 0


def test_versions_are_listed_as_the_reader_does(spark, tmp_path):
    source, out, offsets = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "offsets")
    for name in ("a.bin", "x/b.bin", "x/y/c d.bin", "x/y/z/é.txt", "_tmp/no.bin", ".git/no.bin", "x/_no.bin", "k=1/d.bin"):
        (source / name).parent.mkdir(parents=True, exist_ok=True)
        (source / name).write_bytes(name.encode())
    (source / "empty").mkdir()
    def run(glob=None):
        file_versions(spark, str(source), glob=glob).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", offsets
        ).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["path"], r["length"], r["id_mtime"]) for r in spark.read.parquet(out).collect())

    listed = identity(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(source)))
    assert run() == sorted((r["path"], r["length"], r["id_mtime"]) for r in listed.collect())
    assert len(run()) == 5
    (source / "x" / "b.bin").write_bytes(b"another")
    (source / "x" / "e.txt").write_bytes(b"left out")
    added = run("*.bin")
    assert len(added) == 6 and [n for p, n, _ in added if p.endswith("x/b.bin")] == [7, 7]


DAY = 86_400_000_000


def _greedy(times):
    out, last = [], None
    for t in sorted(times):
        if last is None or t - last >= DAY:
            out.append(t)
            last = t
    return out


def test_throttle_batch_matches_greedy(spark):
    import random

    rng = random.Random(4)
    rows = [("hot", rng.randrange(40 * DAY)) for _ in range(2000)] + [("rare", rng.randrange(400 * DAY)) for _ in range(30)]
    rows += [("edge", 5), ("edge", 5 + DAY), ("edge", 4 + 2 * DAY), ("one", 9)]
    df = spark.createDataFrame(rows, "k string, us bigint").withColumn("ts", F.timestamp_micros("us"))
    got = {}
    for r in throttle_batch(df, "k", "ts").collect():
        got.setdefault(r["key"], []).append(r["at_us"])
    for key in ("hot", "rare", "edge", "one"):
        assert sorted(got[key]) == _greedy([t for k, t in rows if k == key])


def test_throttle_stream_remembers_across_batches(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out, offsets = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "offsets")
    batches = [[("a", 0), ("a", DAY - 1), ("b", 10)], [("a", DAY), ("a", DAY + 5), ("b", DAY + 9)]]
    for rows in batches:
        spark.createDataFrame(rows, "k string, us bigint").withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string, us bigint, ts timestamp").parquet(source)
        throttle_stream(stream, "k", "ts").writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", offsets
        ).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["key"], r["at_us"]) for r in spark.read.parquet(out).collect())
    assert got == [("a", 0), ("a", DAY), ("b", 10)]


def test_nothing_is_cut_by_default(spark):
    import json

    cells = [{"cell_type": "markdown", "source": f"c{n}", "attachments": {"p": {"image/png": "aGk="}}} for n in range(301)]
    cells.append({"cell_type": "code", "source": "x", "outputs": [{"output_type": "stream", "text": "y" * 9000}]})
    docs = spark.createDataFrame([(1, json.dumps({"cells": cells})), (2, '{"cells": []}')], "i int, t string")
    rows = notebooks.notebook_cells(docs, "i", "t").collect()
    assert [r["n_cells"] for r in rows if r["i"] == 1] == [302] * 302
    assert [(r["cell"], r["n_cells"]) for r in rows if r["i"] == 2] == [(None, 0)]
    assert max(len(r["outputs"] or "") for r in rows) == 9000
    few = notebooks.notebook_cells(docs, "i", "t", max_cells=2).filter("i = 1").collect()
    assert [(r["n_cells"], r["truncated"]) for r in few] == [(302, True)] * 2
    assert notebooks.attachments(docs, "i", "t").count() == 301

    wide = spark.createDataFrame([(1, ",".join(map(str, range(100))))], "i int, t string")
    assert len(delimited.delimited_rows(wide, "i", "t").first()["cells"]) == 100
    cut = delimited.delimited_rows(wide, "i", "t", max_cols=64).first()
    assert (len(cut["cells"]), cut["n_cols"], cut["truncated"]) == (64, 100, True)
    tables = {f"t{n:02}": spark.range(1) for n in range(65)}
    assert overview.table_summary(tables).count() == 65


def test_archives_are_listed_whole(spark):
    import io
    import zipfile

    from shelfmark.sources.archives import list_archives

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for k in range(50_010):
            archive.writestr(str(k), b"")
    files = spark.createDataFrame([(1, bytearray(buffer.getvalue()))], "k int, content binary")
    assert list_archives(files, "k", "content").count() == 50_010
    cut = list_archives(files, "k", "content", limit=3).collect()
    assert [(r.ord, r.total, r.truncated) for r in cut] == [(k, 50_010, True) for k in range(3)]


def test_archives_of_a_batch_are_not_held_together():
    import random

    import pyarrow as pa

    from shelfmark.plans.source_queries import _zips

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1, 61)), "text": [random.Random(k).randbytes(50_000).hex() for k in range(60)]})
    made = list(_zips(iter([batch])))
    assert [k for b in made for k in b.column("doc_id").to_pylist()] == list(range(1, 61))
    assert len(made) > 1 and max(b.nbytes for b in made) < 1_300_000
