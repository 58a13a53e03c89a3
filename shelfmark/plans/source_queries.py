"""Sources, sinks and streams over the given tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import constants as C
from ..functions.signatures import read_head
from ..scratch import scratch_path
from ..sources import archives, delimited, files, lines, notebooks, overview, sections, sinks
from ..streaming.catalog import catalog_rescan, start_catalog
from ..streaming.throttle import throttle_batch, throttle_stream
from .derived import FILES_CTE, part_files
from .registry import query, table
from .scalar_queries import SQL_EXT, SQL_KNOWN

# --- files --------------------------------------------------------------------------------


LISTED_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
LISTED_SQL = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows FROM {t}" for t in LISTED_TABLES)


def _with_rows(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """Listed files (path, length) by the table they belong to, with the rows these tables hold."""
    name = F.regexp_extract("path", r"([^/]+)\.parquet(?:/[^/]*)?$", 1)
    listed = found.groupBy(name.alias("name")).agg(F.bool_and(F.col("length") > 0).alias("all_filled"))
    counts = [table(spark, sf_dir, t).agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("name"), "n_rows") for t in LISTED_TABLES]
    return listed.join(reduce(DataFrame.unionByName, counts), "name")


@query("s1_scan_files", f"SELECT name, true AS all_filled, n_rows FROM ({LISTED_SQL})")
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the stored tables, held against what the tables hold."""
    return _with_rows(spark, sf_dir, files.scan_files(spark, [sf_dir], known=("parquet",)))


@query("s2_expand_inputs", f"""
WITH {FILES_CTE} SELECT count(*) FILTER (WHERE {SQL_EXT} IN ({SQL_KNOWN})) AS kept, count(*) FILTER (WHERE {SQL_EXT} NOT IN ({SQL_KNOWN})) + 14 AS skipped FROM files""")
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit part paths plus the folder of the 14 tables, which holds no registered format."""
    return files.input_report(files.expand_inputs(spark, [sf_dir], part_files(spark, sf_dir)))


@query("s3_read_head", """
SELECT doc_id, CAST(least(strlen(text), 16384) AS BIGINT) AS head_bytes, strlen(text) > 16384 AS was_longer FROM documents""")
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.encode("text", "UTF-8")
    head = read_head(content, F.octet_length(content), C.TEXT_SNIFF_BYTES)
    return table(spark, sf_dir, "documents").select("doc_id", head.alias("h")).select(
        "doc_id", F.octet_length("h.head").cast("bigint").alias("head_bytes"), "h.was_longer"
    )


# --- delimited ----------------------------------------------------------------------------

_D = "(CASE c_custkey % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END)"
CSV_TEXT = (
    f"chr(10) || 'id' || {_D} || 'name' || {_D} || 'note' || chr(13) || chr(10) || c_custkey || {_D} || c_name || {_D} "
    f"|| '\"a' || {_D} || '\"\"b\"\"' || chr(10) || c_mktsegment || '\"' || chr(10) || chr(10) || '\"' || c_name || '\"x' || {_D} || c_acctbal"
)


@query("s4_scan_delimited", f"""
WITH t AS (SELECT *, {_D} AS d FROM customer)
SELECT c_custkey, d AS delimiter, CAST(0 AS INT) AS row_no, 'id' || chr(31) || 'name' || chr(31) || 'note' AS cells FROM t
UNION ALL SELECT c_custkey, d, 1, c_custkey || chr(31) || c_name || chr(31) || 'a' || d || '"b"' || chr(10) || c_mktsegment FROM t
UNION ALL SELECT c_custkey, d, 2, c_name || 'x' || chr(31) || c_acctbal || chr(31) FROM t""")
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small delimited file per customer, in four delimiters (the pipe one is forced)."""
    docs = table(spark, sf_dir, "customer").select(
        "c_custkey", F.expr(CSV_TEXT).alias("text"), F.when(F.col("c_custkey") % 4 == 3, "psv").otherwise("csv").alias("ext")
    )
    rows = delimited.delimited_rows(docs, "c_custkey", "text", F.col("ext"))
    return rows.withColumn("cells", F.array_join("cells", "\u001f"))


@query("s4_sniff_ties", """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN ';' WHEN 1 THEN chr(9) WHEN 2 THEN ',' WHEN 3 THEN ',' WHEN 4 THEN ';' ELSE chr(9) END AS delimiter FROM part""")
def s4_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr(
        "CASE p_partkey % 6 WHEN 0 THEN p_name || ',a;b' WHEN 1 THEN p_name || ';a' || chr(9) || 'b' WHEN 2 THEN p_name "
        "WHEN 3 THEN '\";;;\",' || p_name WHEN 4 THEN chr(10) || '  ' || chr(10) || p_name || ';x;y,z' ELSE 'a,b' || chr(9) || p_brand || chr(9) || ',' END"
    )
    return table(spark, sf_dir, "part").select("p_partkey", delimited.sniff_delimiter(line).alias("delimiter"))


# --- notebooks ----------------------------------------------------------------------------

def _quoted(column: str):
    """The column as a JSON string."""
    packed = F.to_json(F.struct(F.col(column).alias("t")))
    return F.substring(packed, F.lit(6), F.length(packed) - 6)


def _notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, key = _quoted("text"), F.col("doc_id").cast("string")
    packed = F.replace(F.base64(F.encode("text", "UTF-8")), F.lit("\r\n"), F.lit("\\n"))
    md = F.concat(
        F.lit('{"cell_type":"markdown","source":["# D'), key, F.lit('\\n","![p](attachment:p.png)\\n"],"attachments":{"p.png":{"text/x":"no","image/png":"'),
        F.substring(packed, 1, 4), F.lit("\\n"), F.substring(packed, F.lit(5), F.length(packed)), F.lit('"}}}'),
    )
    code = F.concat(
        F.lit('{"cell_type":"code","source":'), text,
        F.lit(',"outputs":[{"output_type":"stream","text":["a","b '), key, F.lit('\\n"]},'),
        F.lit('{"output_type":"error","traceback":["\\u001b[31mE\\u001b[0m","x"]},{"output_type":"display_data","data":{"image/png":"x"}}]}'),
    )
    meta = F.when(F.col("doc_id") % 2 == 0, '"metadata":{"kernelspec":{"language":"julia"}},').otherwise("")
    whole = F.concat(F.lit("{"), meta, F.lit('"cells":['), md, F.lit(","), code, F.lit(',{"cell_type":"raw","source":"r  "}]}'))
    doc = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("not json "), key, F.lit(" "), "text")).otherwise(whole)
    return table(spark, sf_dir, "documents").select("doc_id", doc.alias("doc"))


@query("s5_scan_notebooks", r"""
WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN 'julia' ELSE 'python' END AS lang FROM documents WHERE doc_id % 10 <> 0)
SELECT doc_id, CAST(0 AS INT) AS cell, 'markdown' AS kind, '# D' || doc_id || chr(10) || '![p](c0/attachment:p.png)' AS source, '' AS outputs, lang, CAST(3 AS INT) AS n_cells FROM d
UNION ALL SELECT doc_id, 1, 'code', regexp_replace(text, '\s+$', ''), 'ab ' || doc_id || chr(10) || 'E' || chr(10) || 'x' || chr(10) || '[image output]', lang, 3 FROM d
UNION ALL SELECT doc_id, 2, 'raw', 'r', '', lang, 3 FROM d
UNION ALL SELECT doc_id, 0, 'raw-json', 'not json ' || doc_id || ' ' || text, '', 'json', 1 FROM documents WHERE doc_id % 10 = 0""")
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notebooks.notebook_cells(_notebooks(spark, sf_dir), "doc_id", "doc")


@query("s6_extract_attachments", """
SELECT doc_id, 'c0/attachment:p.png' AS name, text AS content FROM documents WHERE doc_id % 10 <> 0 AND text <> ''""")
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = notebooks.attachments(_notebooks(spark, sf_dir), "doc_id", "doc")
    return found.withColumn("content", F.col("content").cast("string"))


# --- line formats -------------------------------------------------------------------------

BASELINE_LINE = (
    "CASE p_partkey % 5 WHEN 0 THEN '# ' || p_name WHEN 1 THEN '  ' WHEN 2 THEN p_partkey || '.x  ' || p_retailprice || ' # slow ' || p_name "
    "WHEN 3 THEN ' ' || p_partkey || '.y' ELSE p_partkey || '.z ' || p_size END"
)


@query("s7_scan_baseline", """
SELECT p_partkey, p_partkey || CASE p_partkey % 5 WHEN 2 THEN '.x' WHEN 3 THEN '.y' ELSE '.z' END AS key,
  CASE p_partkey % 5 WHEN 2 THEN p_retailprice WHEN 4 THEN CAST(p_size AS DOUBLE) END AS value,
  CASE p_partkey % 5 WHEN 2 THEN 'slow ' || p_name ELSE '' END AS reason, p_partkey % 5 <> 2 AS unexplained FROM part WHERE p_partkey % 5 >= 2""")
def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = table(spark, sf_dir, "part").select("p_partkey", F.expr(BASELINE_LINE).alias("line"))
    return lines.scan_baseline(text)


@query("s8_scan_measurements", """
SELECT 'run-' || event_id AS name, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS ms,
  CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'ok' END AS status FROM events WHERE event_id % 50 <> 7""")
def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements written as text files and read back."""
    text = table(spark, sf_dir, "events").select(F.expr(
        "CASE WHEN event_id % 50 = 7 THEN 'noise' ELSE 'run-' || event_id || chr(9) || "
        "CASE WHEN event_type = 'error' THEN 'FAIL' ELSE CAST(value AS STRING) END END"
    ).alias("value"))
    path = scratch_path(spark, "runs")
    text.write.text(path)
    return lines.scan_measurements(spark.read.text(path), "value").select("name", "ms", "status")


@query("s9_scan_locales", """
SELECT CAST(conv_id AS VARCHAR) AS locale, CAST(turn AS INT) AS ord, 'k_' || (turn - turn % 2) AS key,
  replace(replace(text, chr(10), ' '), '"', '') AS value FROM conversations WHERE turn % 5 <> 4""")
def s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr(
        "CASE WHEN turn % 5 = 4 THEN '# ' || replace(text, chr(10), ' ') ELSE 'k_' || (turn - turn % 2) || ' = \"' || "
        "replace(replace(text, chr(10), ' '), '\"', '') || '\"' END"
    )
    text = table(spark, sf_dir, "conversations").select(
        F.concat(F.col("conv_id").cast("string"), F.lit(".toml")).alias("file"),
        F.col("turn").cast("int").alias("ord"), line.alias("line"),
    )
    return lines.scan_locales(text)


# --- archives -----------------------------------------------------------------------------

def _zip_of(key: int, text: str) -> bytes | None:
    if key % 9 == 0:
        return b"PK\x03\x04 not really"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("b/", b"")
        archive.writestr(f"b/text {key}.txt", text)
        archive.writestr("é.bin", b"12345")
        archive.writestr("a.txt", text[: key % 50])
    return buffer.getvalue()


def _zips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, content, size = [], [], 0
        for key, text in zip(batch.column("doc_id"), batch.column("text")):
            keys.append(key.as_py())
            content.append(_zip_of(keys[-1], text.as_py()))
            size += len(content[-1])
            # A batch of texts is not held as archives too.
            if size >= 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(content, pa.binary())], names=["doc_id", "content"])
                keys, content, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(content, pa.binary())], names=["doc_id", "content"])


@query("s10_scan_archives", """
WITH d AS (SELECT doc_id, text FROM documents WHERE doc_id % 9 <> 0)
SELECT doc_id, CAST(0 AS INT) AS ord, 'b/' AS name, true AS is_dir, CAST(0 AS BIGINT) AS size FROM d
UNION ALL SELECT doc_id, 1, 'b/text ' || doc_id || '.txt', false, strlen(text) FROM d
UNION ALL SELECT doc_id, 2, 'é.bin', false, 5 FROM d
UNION ALL SELECT doc_id, 3, 'a.txt', false, strlen(left(text, CAST(doc_id % 50 AS INT))) FROM d""")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into an archive of its own; only the directories are read."""
    packed = table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(
        _zips, "doc_id bigint, content binary"
    )
    return archives.list_archives(packed, "doc_id", "content")


# --- sections, sinks, overview ------------------------------------------------------------

SECTIONS = (
    "'intro' || chr(10) || '## v1 ' || chr(10) || '- ' || replace(text, '##', '') || chr(10) || '## v' || (1 + doc_id % 2) || chr(13) || chr(10) "
    "|| '- short' || chr(10) || '##  Last' || chr(10) || CASE doc_id % 4 WHEN 0 THEN '- TODO ' WHEN 1 THEN '- a placeholder image ' WHEN 2 THEN '- [placeholder] ' ELSE 'no bullet ' END || repeat('x', 80)"
)


@query("s11_split_sections", r"""
WITH d AS (SELECT doc_id, regexp_replace('- ' || replace(text, '##', ''), '^\s+|\s+$', '', 'g') AS first FROM documents)
SELECT doc_id, CAST(0 AS INT) AS section, 'v1' AS heading, doc_id % 2 = 1 AS "unique", length(first) >= 80 AS long_enough, true AS has_bullet,
  regexp_matches(first, '(?i)\b(?:TODO|TBD|CHANGEME)\b') AS unfilled FROM d
UNION ALL SELECT doc_id, 1, 'v' || (1 + doc_id % 2), doc_id % 2 = 1, false, true, false FROM d
UNION ALL SELECT doc_id, 2, 'Last', true, true, doc_id % 4 <> 3, doc_id % 4 IN (0, 2) FROM d""")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(SECTIONS).alias("md"))
    return sections.split_sections(docs, "doc_id", "md").drop("body", "valid")


@query("s12_sink_json", """
SELECT '{"doc_id":' || doc_id || ',"lang":"' || lang || '","score":' || CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE CAST(n_chars / 8.0 AS VARCHAR) END || '}' AS json FROM documents""")
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a NaN or an infinity written as JSON lines and read back as text."""
    score = F.expr("CASE doc_id % 6 WHEN 0 THEN double('NaN') WHEN 3 THEN double('Infinity') ELSE n_chars / 8.0D END")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", score.alias("score"))
    path = scratch_path(spark, "json")
    sinks.write_json(rows, path)
    return spark.read.text(path).select(F.col("value").alias("json"))


@query("s13_sink_gfm_table", r"""
WITH t AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n, count(*) OVER () AS total FROM orders)
SELECT 0 AS line_no, '| # | o\_orderkey | o\_orderpriority |' AS line UNION ALL SELECT 1, '| --- | --- | --- |'
UNION ALL SELECT n + 1, '| ' || n || ' | ' || o_orderkey || ' | ' || o_orderpriority || ' |' FROM t WHERE n <= 20
UNION ALL SELECT DISTINCT 22, 'Showing the first 20 of ' || total || ' rows.' FROM t""")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return sinks.gfm_table(
        orders, [F.col("o_totalprice").desc(), F.col("o_orderkey")], ["o_orderkey", "o_orderpriority"], 20
    )


@query("s14_sink_baseline", """
SELECT 'c' || o_custkey || CASE WHEN o_custkey % 5 = 0 THEN '  # kept ' || o_custkey ELSE '' END AS line FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pass set written as a sorted baseline with its hand-written reasons, and read back."""
    passed = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("key")
    )
    reasons = table(spark, sf_dir, "customer").filter("c_custkey % 5 = 0").selectExpr(
        "'c' || c_custkey AS key", "'kept ' || c_custkey AS reason"
    )
    path = scratch_path(spark, "baseline")
    sinks.write_baseline(passed, "key", path, drift=0.05, reasons=reasons)
    return spark.read.text(path).select(F.col("value").alias("line"))


_TABLE_COLUMNS = {
    "benchmark": "item_id, text", "conversations": "conv_id, turn, role, text",
    "customer": "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment",
    "documents": "doc_id, text, lang, source, n_chars", "embeddings": "vec_id, embedding, label",
    "events": "event_id, ts, user_id, event_type, value, props", "labels": "doc_id, quality, toxic",
    "lineitem": "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate",
    "nation": "n_nationkey, n_name, n_regionkey",
    "orders": "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority",
    "pages": "page_id, url, html", "part": "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice",
    "region": "r_regionkey, r_name", "supplier": "s_suppkey, s_name, s_nationkey, s_acctbal",
}


@query("s15_table_overview", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, CAST({len(c.split(', '))} AS BIGINT) AS n_columns, '{c}' AS columns, count(*) AS n_rows FROM {n}"
    for n, c in _TABLE_COLUMNS.items()))
def s15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.table_summary({n: table(spark, sf_dir, n) for n in _TABLE_COLUMNS})


@query("s15_table_preview", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN length(text) > 160 THEN left(text, 160) || '…' ELSE text END AS text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars
FROM documents ORDER BY documents.doc_id LIMIT 50""")
def s15_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.table_preview(table(spark, sf_dir, "documents"), "doc_id", max_chars=160)


# --- streams ------------------------------------------------------------------------------

@query("t1s_incremental_catalog", f"SELECT name, true AS all_filled, n_rows, CAST(0 AS BIGINT) AS new_files FROM ({LISTED_SQL})")
def t1s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored tables streamed into a catalogue; a second look finds nothing new."""
    catalog, checkpoint = scratch_path(spark, "catalog"), scratch_path(spark, "offsets")
    start_catalog(spark, sf_dir, catalog, checkpoint, glob="*.parquet").awaitTermination()
    again = catalog_rescan(spark, sf_dir, catalog).agg(F.count("*").alias("new_files"))
    stored = spark.read.parquet(catalog)
    return _with_rows(spark, sf_dir, stored).withColumn("new_files", again.scalar())


THROTTLE_SQL = """
WITH RECURSIVE e AS (SELECT DISTINCT user_id, epoch_us(ts) AS t FROM events),
r AS (SELECT user_id, min(t) AS t FROM e GROUP BY user_id
  UNION ALL SELECT r.user_id, min(e.t) FROM r JOIN e ON e.user_id = r.user_id AND e.t >= r.t + 86400000000 GROUP BY r.user_id, r.t)
SELECT user_id, t AS at_us FROM r"""


@query("t2s_throttle_batch", THROTTLE_SQL)
def t2s_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return throttle_batch(table(spark, sf_dir, "events"), "user_id", "ts").withColumnRenamed("key", "user_id")


@query("t2s_throttle_stream", THROTTLE_SQL)
def t2s_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateful stream over the stored events, drained once."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out, checkpoint = scratch_path(spark, "throttle"), scratch_path(spark, "offsets")
    try:
        schema = table(spark, sf_dir, "events").schema
        events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        accepted = throttle_stream(events, "user_id", "ts")
        accepted.writeStream.format("parquet").outputMode("append").option("path", out).option(
            "checkpointLocation", checkpoint
        ).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(out).select(F.col("key").alias("user_id"), "at_us")


