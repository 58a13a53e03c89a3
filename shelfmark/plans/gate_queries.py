"""Gates: new results against recorded ones, over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.paths import DEFAULT_KNOWN
from ..operators import gates, limits, summaries, vectors
from .derived import FILES_CTE, RUNS_CTE, case_of, event_runs, part_files
from .pipelines import backlog_report, performance_gate, view_documents
from .registry import query, table


def _known_sql() -> str:
    return ", ".join(f"'{e}'" for e in sorted(DEFAULT_KNOWN))


# --- joins --------------------------------------------------------------------------------

@query("j1_regression_diff", """
WITH b AS (SELECT p_partkey AS key FROM part WHERE p_size <= 25), p AS (SELECT p_partkey AS key FROM part WHERE p_partkey % 7 <> 0),
g AS (SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)
SELECT key, 'regressed' AS status FROM b WHERE key IN (FROM p) AND key NOT IN (FROM g)
UNION ALL SELECT key, 'missing' FROM b WHERE key NOT IN (FROM p)
UNION ALL SELECT key, 'new' FROM g WHERE key NOT IN (FROM b)""")
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    return gates.regression_diff(
        part.filter("p_size <= 25").select(F.col("p_partkey").alias("key")),
        part.filter("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("key")),
        lines.filter("l_returnflag = 'R' AND l_quantity > 40").select(F.col("l_partkey").alias("key")),
        "key",
    )


@query("j1_regression_by_ext", f"""
WITH {FILES_CTE}, e AS (SELECT ord, regexp_extract(path, '([^.]*)$', 1) AS ext FROM files),
b AS (SELECT DISTINCT ext FROM e WHERE ord % 3 = 0), p AS (SELECT DISTINCT ext FROM e WHERE ord % 17 NOT IN (2, 5)),
g AS (SELECT DISTINCT ext FROM e WHERE ord % 17 NOT IN (2, 9, 11))
SELECT ext, 'regressed' AS status FROM b WHERE ext IN (FROM p) AND ext NOT IN (FROM g)
UNION ALL SELECT ext, 'missing' FROM b WHERE ext NOT IN (FROM p)
UNION ALL SELECT ext, 'new' FROM g WHERE ext NOT IN (FROM b)""")
def j1_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = part_files(spark, sf_dir).withColumn("ext", F.regexp_extract("path", r"([^.]*)$", 1))
    return gates.regression_diff(
        files.filter("ord % 3 = 0").select("ext"),
        files.filter("ord % 17 NOT IN (2, 5)").select("ext"),
        files.filter("ord % 17 NOT IN (2, 9, 11)").select("ext"),
        "ext",
    )


@query("j2_self_gate", """
WITH now AS (SELECT 'r' || (event_id // 2) AS name, value * 4 AS ms FROM events WHERE event_id % 2 = 1 AND user_id % 11 <> 0),
was AS (SELECT 'r' || (event_id // 2) AS name, greatest(value, 0.001) AS was FROM events WHERE event_id % 2 = 0 AND event_id % 14 <> 0),
j AS (SELECT now.name, ms, was, round_even(ms / was * 100, 0) / 100 AS ratio FROM now LEFT JOIN was ON now.name = was.name)
SELECT name, ms, was, ratio, CASE WHEN was IS NULL THEN 'unseen' ELSE 'suspect' END AS verdict FROM j
WHERE was IS NULL OR (ms >= 25 AND ms - was >= 40 AND ratio > 2.5)""")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "events").withColumn(
        "name", F.concat(F.lit("r"), F.expr("event_id div 2").cast("string"))
    )
    now = named.filter("event_id % 2 = 1").select("name", (F.col("value") * 4).alias("ms"), "user_id")
    was = named.filter("event_id % 2 = 0 AND event_id % 14 <> 0").select("name", F.col("value").alias("ms"))
    return gates.self_gate(now, was, exempt=F.col("user_id") % 11 == 0)


@query("j3_peer_gate", f"""
WITH {RUNS_CTE}, e AS (SELECT ext, name, ms, peer_ms, round_even(ms / peer_ms * 100, 0) / 100 AS ratio FROM runs
  WHERE peer_ms > 0 AND ms >= 25 AND ms - peer_ms >= 40),
w AS (SELECT *, row_number() OVER (PARTITION BY ext ORDER BY ratio DESC, name) AS rn FROM e)
SELECT ext, name, ms, peer_ms, ratio, CASE ext WHEN 'avif' THEN 6.0::DOUBLE WHEN 'jpg' THEN 9000.0::DOUBLE ELSE 3.0::DOUBLE END AS max_ratio FROM w
WHERE rn = 1 AND ratio > CASE ext WHEN 'avif' THEN 6.0 WHEN 'jpg' THEN 9000.0 ELSE 3.0 END""")
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = spark.createDataFrame([("avif", 6.0), ("jpg", 9000.0)], "ext string, max_ratio double")
    return gates.peer_gate(event_runs(spark, sf_dir), allowed)


@query("j4_build_compare", """
WITH o AS (SELECT vec_id AS name, vec_id % 7 <> 0 AS ok, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 255) AS s FROM embeddings WHERE vec_id % 10 <> 0),
n AS (SELECT vec_id AS name, vec_id % 9 <> 0 AS ok, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (255 + (vec_id % 5) * 12)) AS s FROM embeddings WHERE vec_id % 11 <> 0),
j AS (SELECT coalesce(o.name, n.name) AS name, coalesce(o.ok, false) AS a, coalesce(n.ok, false) AS b,
  list_avg(list_transform(list_zip(o.s, n.s), lambda z: abs(z[1] - z[2]))) AS d FROM o FULL JOIN n ON o.name = n.name)
SELECT name, CASE WHEN a AND NOT b THEN 'LOST' WHEN b AND NOT a THEN 'GAINED' WHEN d >= 2 THEN 'CHANGED' ELSE 'SAME' END AS status,
  CASE WHEN a AND b THEN round(d, 6) END AS delta FROM j WHERE a OR b""")
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors_ = table(spark, sf_dir, "embeddings")

    def build(keep: str, ok: str, scale):
        return vectors_.filter(keep).select(
            F.col("vec_id").alias("name"), F.expr(ok).alias("ok"),
            F.transform("embedding", lambda x: x.cast("double") * scale).alias("samples"),
        )

    old = build("vec_id % 10 <> 0", "vec_id % 7 <> 0", F.lit(255))
    new = build("vec_id % 11 <> 0", "vec_id % 9 <> 0", 255 + (F.col("vec_id") % 5) * 12)
    return gates.build_compare(old, new).withColumn("delta", F.round("delta", 6))


@query("j5_expected_values", """
SELECT vec_id AS name, CASE WHEN vec_id % 13 = 0 THEN 'missing' WHEN vec_id % 11 <= 8 THEN 'ok' ELSE 'wrong' END AS verdict FROM embeddings""")
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every channel of each vector; the sample is off by vec_id modulo 11 in one channel, or absent."""
    base = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("name"),
        F.transform("embedding", lambda x: (x * 100).cast("int")).alias("want"),
    )
    off = (F.col("name") % 11).cast("int")
    got = base.filter("name % 13 <> 0").select(
        "name", F.transform("want", lambda w, i: F.when(i == 1, w - off).otherwise(w)).alias("got")
    )
    return gates.expected_values(base, got).select("name", "verdict")


LOCALE_ROWS = {
    "locale": "CAST(conv_id AS VARCHAR(20))",
    "key": "'k' || (turn - turn % 2)",
    "ord": "turn",
    "value": "CASE (conv_id + turn) % 5 WHEN 0 THEN '{a} {b} ' WHEN 1 THEN '{b}{a} ' WHEN 2 THEN '{a} ' ELSE '' END || text",
}


@query("j6_key_parity", r"""
WITH e AS (SELECT CAST(conv_id AS VARCHAR) AS locale, 'k' || (turn - turn % 2) AS key, turn AS ord,
  CASE (conv_id + turn) % 5 WHEN 0 THEN '{a} {b} ' WHEN 1 THEN '{b}{a} ' WHEN 2 THEN '{a} ' ELSE '' END || text AS value FROM conversations),
f AS (SELECT locale, key, arg_min(value, ord) AS value, count(*) AS n FROM e GROUP BY ALL),
p AS (SELECT *, list_sort(regexp_extract_all(value, '\{[a-z_]+\}')) AS ph FROM f), c AS (SELECT * FROM p WHERE locale = '3')
SELECT p.locale, (SELECT count(*) FROM c) - count(c.key) AS missing, count(*) FILTER (WHERE c.key IS NULL) AS extra,
  count(*) FILTER (WHERE p.n > 1) AS duplicates, count(*) FILTER (WHERE c.ph <> p.ph) AS placeholder_mismatches
FROM p LEFT JOIN c ON p.key = c.key GROUP BY p.locale""")
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "conversations").selectExpr(*[f"{e} AS {n}" for n, e in LOCALE_ROWS.items()])
    return gates.key_parity(entries, "3")


@query("j6_missing_keys", """
WITH e AS (SELECT lang AS locale, source || '-' || (doc_id % 50) AS key FROM documents)
SELECT DISTINCT key, 'missing' AS status FROM e WHERE locale = 'en' AND key NOT IN (SELECT key FROM e WHERE locale = 'fr')
UNION ALL SELECT DISTINCT key, 'extra' FROM e WHERE locale = 'fr' AND key NOT IN (SELECT key FROM e WHERE locale = 'en')""")
def j6_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "documents").selectExpr("lang AS locale", "source || '-' || (doc_id % 50) AS key")
    return gates.missing_keys(entries, "en", "fr")


@query("j7_manifest_diff", """
WITH e AS (SELECT doc_id AS path, strlen(text) AS bytes, sha256(text) AS h FROM documents WHERE doc_id % 17 <> 0),
a AS (SELECT doc_id AS path, strlen(t) AS bytes, sha256(t) AS h FROM (SELECT doc_id,
  CASE WHEN doc_id % 23 = 0 THEN text || 'x' WHEN doc_id % 29 = 0 THEN reverse(text) ELSE text END AS t FROM documents WHERE doc_id % 19 <> 0))
SELECT coalesce(e.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'extra'
  WHEN e.bytes <> a.bytes THEN 'changed:bytes' ELSE 'changed:sha256' END AS status
FROM e FULL JOIN a ON e.path = a.path WHERE e.path IS NULL OR a.path IS NULL OR e.bytes <> a.bytes OR e.h <> a.h""")
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = F.expr("CASE WHEN doc_id % 23 = 0 THEN text || 'x' WHEN doc_id % 29 = 0 THEN reverse(text) ELSE text END")
    expected = gates.file_record(docs.filter("doc_id % 17 <> 0"), "doc_id", F.encode("text", "UTF-8"))
    actual = gates.file_record(docs.filter("doc_id % 19 <> 0"), "doc_id", F.encode(changed, "UTF-8"))
    return gates.manifest_diff(expected, actual)


STORED_SIZE = case_of("l_linenumber", ["96", "256", "768", "2560", "256", "96", "16"])


def _stored(spark: SparkSession, sf_dir: str, files: DataFrame) -> DataFrame:
    """Stored results from order lines; odd suppliers hold a stale time stamp."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("ord"), F.expr(f"CAST({STORED_SIZE} AS INT)").alias("size"),
        (F.col("l_suppkey") % 2).alias("stale"),
    )
    return lines.join(files, "ord").select("path", "length", (F.col("mtime") - F.col("stale")).alias("mtime"), "size")


BACKLOG_SQL = f"""
WITH {FILES_CTE}, s AS (SELECT DISTINCT path, length, mtime - l_suppkey % 2 AS mtime, CAST({STORED_SIZE} AS INT) AS size
  FROM lineitem JOIN files ON l_partkey = ord),
r AS (SELECT *, unnest([2560, 768, 256, 96]) AS size FROM files),
b AS (SELECT r.ord, r.path, r.length, r.mtime, r.size, s.path IS NOT NULL AS stored FROM r LEFT JOIN s
  ON r.path = s.path AND r.length = s.length AND r.mtime = s.mtime AND r.size = s.size)
"""


@query("j8_work_backlog", BACKLOG_SQL + "SELECT ord, path, size FROM b WHERE NOT stored")
def j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = part_files(spark, sf_dir)
    return gates.work_backlog(files, (90, 200, 700, 9000), _stored(spark, sf_dir, files)).select("ord", "path", "size")


@query("j8_backlog_verdict", BACKLOG_SQL + """,
o AS (SELECT ord, path, CASE WHEN stored THEN 'already' WHEN (ord + size) % 5 = 0 THEN 'failed' ELSE 'built' END AS outcome FROM b)
SELECT path, CASE WHEN NOT bool_or(outcome IN ('built', 'already')) THEN 'failed' WHEN bool_or(outcome = 'failed') THEN 'partial'
  WHEN bool_or(outcome = 'built') THEN 'built' ELSE 'already' END AS verdict FROM o GROUP BY path""")
def j8_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = part_files(spark, sf_dir)
    sizes = (90, 200, 700, 9000)
    key = ["path", "length", "mtime", "size"]
    stored = _stored(spark, sf_dir, files).distinct().withColumn("stored", F.lit(True))
    attempts = gates.requested_sizes(files, sizes).join(stored, key, "left").withColumn(
        "outcome",
        F.when(F.col("stored"), "already").when((F.col("ord") + F.col("size")) % 5 == 0, "failed").otherwise("built"),
    )
    return gates.backlog_verdict(attempts)


@query("j11_tier_coverage", f"""
WITH {RUNS_CTE}, t AS (SELECT CASE WHEN ord % 4 = 0 THEN upper(name) ELSE 'tier-' || name END AS name, ext, ms FROM runs WHERE tier IN ('small', 'medium', 'large') AND ext IN ('jpg', 'png', 'avif', 'dds')),
r AS (SELECT name, ext, ms FROM runs WHERE tier = 'single' AND ord % 3 = 0),
a AS (SELECT *, 'tiered' AS corpus FROM t WHERE lower(name) NOT IN (SELECT lower(name) FROM r)
  UNION ALL SELECT *, 'real' FROM r WHERE ext NOT IN (SELECT ext FROM t))
SELECT corpus, ext, count(*) AS n, count(DISTINCT name) AS names, round(sum(ms), 4) AS total_ms FROM a GROUP BY ALL""")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = event_runs(spark, sf_dir)
    name = F.when(F.col("ord") % 4 == 0, F.upper("name")).otherwise(F.concat(F.lit("tier-"), "name"))
    tiered = runs.filter("tier IN ('small', 'medium', 'large') AND ext IN ('jpg', 'png', 'avif', 'dds')")
    tiered = tiered.select(name.alias("name"), "ext", "ms")
    real = runs.filter("tier = 'single' AND ord % 3 = 0").select("name", "ext", "ms")
    return gates.tier_coverage(tiered, real).groupBy("corpus", "ext").agg(
        F.count("*").alias("n"), F.count_distinct("name").alias("names"), F.round(F.sum("ms"), 4).alias("total_ms")
    )


# --- aggregations -------------------------------------------------------------------------

OUTCOME = "CASE event_type WHEN 'view' THEN 'built' WHEN 'click' THEN 'already' WHEN 'signup' THEN 'partial' WHEN 'purchase' THEN 'failed' ELSE 'skipped' END"


@query("a1_run_report", """
SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS found, count(*) FILTER (WHERE event_type = 'view') AS built,
  count(*) FILTER (WHERE event_type = 'click') AS already, count(*) FILTER (WHERE event_type = 'signup') AS partial,
  count(*) FILTER (WHERE event_type = 'purchase') AS failed, count(*) FILTER (WHERE event_type = 'error') AS skipped FROM events GROUP BY user_id""")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.run_report(table(spark, sf_dir, "events"), F.expr(OUTCOME), ["user_id"])


@query("a2_batch_outcome", """
SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus <> 'F') AS done, count(*) AS total,
  arg_min(o_orderpriority || '-' || o_orderkey, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS first_failure,
  count(*) FILTER (WHERE o_orderstatus <> 'F') = 0 AS is_error FROM orders GROUP BY o_custkey""")
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.concat("o_orderpriority", F.lit("-"), F.col("o_orderkey").cast("string"))
    return summaries.batch_outcome(
        table(spark, sf_dir, "orders"), F.col("o_orderstatus") != "F", reason, F.col("o_orderkey"), ["o_custkey"]
    )


@query("a4_category_rollup", "SELECT p_brand, grouping(p_brand) = 1 AS is_total, count(*) AS n FROM part GROUP BY ROLLUP (p_brand)")
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.category_rollup(table(spark, sf_dir, "part"), "p_brand")


@query("a4_categories_consistent", """
WITH l AS (SELECT p_brand, count(*) AS live FROM part GROUP BY 1),
c AS (SELECT p_brand, count(*) AS n FROM part WHERE NOT (p_brand IN ('Brand#3', 'Brand#8') AND p_size > 30) GROUP BY 1)
SELECT coalesce(c.p_brand, l.p_brand) AS p_brand, n AS claimed, live FROM c FULL JOIN l ON c.p_brand = l.p_brand WHERE n IS DISTINCT FROM live""")
def a4_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    claimed = part.filter("NOT (p_brand IN ('Brand#3', 'Brand#8') AND p_size > 30)").groupBy("p_brand").agg(F.count("*").alias("n"))
    return summaries.categories_consistent(claimed, part, "p_brand")


@query("a5_best_of_n", f"""WITH {RUNS_CTE}
SELECT name, min(ms) AS ms, count(*) AS attempts, CASE WHEN min(ms) IS NULL THEN 'FAIL' ELSE 'ok' END AS status FROM runs GROUP BY name""")
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.best_of_n(event_runs(spark, sf_dir))


NEAREST_RANK = """
SELECT {keys} count(*) AS n, {failed}
  max(value) FILTER (WHERE rn = greatest(ceil(0.50 * c), 1)) AS p50, max(value) FILTER (WHERE rn = greatest(ceil(0.90 * c), 1)) AS p90,
  max(value) FILTER (WHERE rn = greatest(ceil(0.95 * c), 1)) AS p95, max(value) FILTER (WHERE rn = greatest(ceil(0.99 * c), 1)) AS p99
FROM (SELECT *, row_number() OVER ({part} ORDER BY value) AS rn, count(*) OVER ({part}) AS c FROM events) {group}"""


@query("a6_latency_percentiles", NEAREST_RANK.format(
    keys="event_type,", part="PARTITION BY event_type", group="GROUP BY event_type",
    failed="count(*) FILTER (WHERE user_id % 10 = 0) AS failed,"))
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.latency_percentiles(
        table(spark, sf_dir, "events"), ["event_type"], "value", F.col("user_id") % 10 != 0
    )


@query("a6_latency_overall", NEAREST_RANK.format(keys="", part="", group="", failed=""))
def a6_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.latency_percentiles(table(spark, sf_dir, "events"), [], "value")


@query("a7_speed_summary", f"""
WITH {RUNS_CTE}, r AS (SELECT *, CASE WHEN peer_ms > 0 THEN round_even(ms / peer_ms * 100, 0) / 100 END AS ratio FROM runs)
SELECT count(*) AS samples, count(DISTINCT ext) AS formats, count(ratio) AS with_peer, count(*) FILTER (WHERE ratio <= 1) AS as_fast,
  count(*) FILTER (WHERE ratio IS NULL) AS no_peer, round(median(ratio), 6) AS median_ratio FROM r""")
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.speed_summary(event_runs(spark, sf_dir)).withColumn("median_ratio", F.round("median_ratio", 6))


@query("a8_drift", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, max(value) AS hi, min(value) AS lo,
  round(CASE WHEN max(value) > 0 THEN (max(value) - min(value)) / max(value) ELSE 0 END, 9) AS drift FROM events GROUP BY 1""")
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date").cast("string"))
    return summaries.drift(daily, "value", ["day"]).withColumn("drift", F.round("drift", 9))


@query("a8_worst_drift", """
WITH b AS (SELECT user_id, min(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), a AS (SELECT user_id, min(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT round(coalesce(max(CASE WHEN a.v <> 0 AND b.v <> 0 THEN abs(a.v - b.v) / greatest(a.v, b.v) END), 0), 9) AS worst_drift FROM a JOIN b ON a.user_id = b.user_id""")
def a8_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    half = lambda parity: events.filter(f"event_id % 2 = {parity}").groupBy("user_id").agg(F.min("value").alias("v"))
    return summaries.worst_drift(half(0), half(1), "user_id", "v").withColumn("worst_drift", F.round("worst_drift", 9))


@query("a9_passes_by_ext", """
SELECT o_custkey, bool_or(o_orderstatus = 'O') AS passes, count(*) FILTER (WHERE o_orderstatus = 'O') AS ok_samples FROM orders GROUP BY o_custkey""")
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.passes_by_ext(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderstatus") == "O")


@query("a10_object_counts", """
SELECT count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'click') AS clicks,
  count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events""")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"view": "views", "click": "clicks", "purchase": "purchases", "error": "errors"}
    return summaries.object_counts(table(spark, sf_dir, "events"), F.upper("event_type"), names)


@query("a11_log_calls", """
SELECT CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT) AS value, count(*) AS calls FROM events WHERE regexp_matches(props, '"k": \\d+') GROUP BY 1""")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.log_calls(table(spark, sf_dir, "events"), F.col("props"), r'"k": (\d+)')


CLAIM_TEXT = "'Reads ' || (320 + doc_id % 3) || ' file formats, all 300+ extensions and 1' || (doc_id % 10) || '1 more known file types. ' || text"


@query("a12_stale_counts", """
SELECT doc_id, claimed, count(*) AS mentions FROM (
  SELECT doc_id, CAST(320 + doc_id % 3 AS INT) AS claimed FROM documents UNION ALL SELECT doc_id, CAST(101 + (doc_id % 10) * 10 AS INT) FROM documents)
WHERE claimed <> 321 GROUP BY ALL""")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(CLAIM_TEXT).alias("text"))
    return summaries.stale_counts(docs, "doc_id", "text", 321)


# --- sets and top-k -----------------------------------------------------------------------

@query("l3_slowest_k", f"WITH {RUNS_CTE} SELECT ord, name, ms FROM runs WHERE ms IS NOT NULL ORDER BY ms DESC, ord LIMIT 15")
def l3(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = event_runs(spark, sf_dir).filter("ms IS NOT NULL").select("ord", "name", "ms")
    return limits.slowest_k(timed, "ms", 15, tie="ord")


@query("l3_worst_ratio_k", f"""WITH {RUNS_CTE}
SELECT ord, name, round_even(ms / peer_ms * 100, 0) / 100 AS ratio FROM runs WHERE ms IS NOT NULL AND peer_ms > 0 ORDER BY ratio DESC, ord LIMIT 8""")
def l3_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = event_runs(spark, sf_dir).withColumn("ratio", gates.peer_ratio(F.col("ms"), F.col("peer_ms")))
    return limits.slowest_k(rated.filter("ratio IS NOT NULL").select("ord", "name", "ratio"), "ratio", 8, tie="ord")


@query("l5_first_n_of_m", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (SELECT count(*) FROM lineitem) AS total
FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50""")
def l5(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return limits.first_n_of_m(table(spark, sf_dir, "lineitem").select(*columns), columns, 50)


TIER = "CASE o_orderpriority WHEN '1-URGENT' THEN 'small' WHEN '2-HIGH' THEN 'medium' WHEN '3-MEDIUM' THEN 'large' WHEN '5-LOW' THEN 'single' ELSE 'other' END"


@query("l6_tier_order", f"""
SELECT {TIER} AS tier, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 4 ELSE 5 END AS place,
  count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL""")
def l6(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = table(spark, sf_dir, "orders").withColumn("tier", F.expr(TIER)).groupBy("tier").agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )
    return limits.tier_order(
        tiers.withColumn("place", limits.tier_rank(F.col("tier")).cast("int")), "tier"
    )


@query("u1_union_corpora", f"""WITH {RUNS_CTE}, u AS (SELECT * FROM runs WHERE tier = 'small' UNION ALL SELECT * FROM runs WHERE ord % 2 = 0)
SELECT ext, count(*) AS n, count(ms) AS timed FROM u GROUP BY ext""")
def u1(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = event_runs(spark, sf_dir)
    both = limits.union_corpora(runs.filter("tier = 'small'"), runs.filter("ord % 2 = 0"))
    return both.groupBy("ext").agg(F.count("*").alias("n"), F.count("ms").alias("timed"))


@query("u2_distinct_set", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def u2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.distinct_set(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query("u3_set_difference", "SELECT DISTINCT p_partkey AS key FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def u3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.set_difference(
        table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key")),
        table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("key")),
        "key",
    )


# --- vector statistics --------------------------------------------------------------------

@query("q10_sample_sd", """
SELECT vec_id, round(list_stddev_pop(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 16)), 6) AS sd,
  list_stddev_pop(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 16)) < 2 AS flat FROM embeddings""")
def q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = F.transform("embedding", lambda x: x.cast("double") * 16)
    return table(spark, sf_dir, "embeddings").select("vec_id", samples.alias("s")).select(
        "vec_id", F.round(vectors.sample_sd(F.col("s")), 6).alias("sd"), vectors.is_flat(F.col("s")).alias("flat")
    )


@query("q11_mean_abs_delta", """
WITH c AS (SELECT label, min(vec_id) AS first FROM embeddings GROUP BY label)
SELECT e.vec_id, round(list_avg(list_transform(list_zip(e.embedding, b.embedding), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))), 6) AS delta
FROM embeddings e JOIN c ON e.label = c.label JOIN embeddings b ON b.vec_id = c.first""")
def q11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against the first vector of its label."""
    vecs = table(spark, sf_dir, "embeddings")
    first = vecs.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("base"))
    return vecs.join(first, "label").select(
        "vec_id", F.round(vectors.mean_abs_delta(F.col("embedding"), F.col("base")), 6).alias("delta")
    )


def _pixels():
    key = F.col("vec_id")
    return F.transform(
        "embedding",
        lambda x, i: F.when(key % 6 == 5, 77.0)
        .when(key % 6 == 4, 100 + x.cast("double"))
        .when(i >= 64 - key % 40, F.when(key % 2 == 0, 130.0).otherwise(20.0))
        .otherwise(128 + x.cast("double") * 600),
    )


PIXEL_SQL = """list_transform(embedding, lambda x, i: CASE WHEN vec_id % 6 = 5 THEN CAST(77 AS DOUBLE) WHEN vec_id % 6 = 4 THEN 100 + CAST(x AS DOUBLE)
  WHEN i - 1 >= 64 - vec_id % 40 THEN CASE WHEN vec_id % 2 = 0 THEN CAST(130 AS DOUBLE) ELSE CAST(20 AS DOUBLE) END ELSE 128 + CAST(x AS DOUBLE) * 600 END)"""


@query("w8_trailing_flat", f"""
WITH p AS (SELECT vec_id, {PIXEL_SQL} AS s FROM embeddings),
t AS (SELECT vec_id, s, coalesce(list_max(list_transform(s, lambda x, i: CASE WHEN x <> s[-1] THEN i ELSE 0 END)), 0) AS last_other FROM p)
SELECT vec_id, CASE WHEN last_other = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(len(s) - last_other AS DOUBLE) / len(s) END AS tail FROM t""")
def w8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", _pixels().alias("s")).select(
        "vec_id", vectors.trailing_flat(F.col("s")).alias("tail")
    )


@query("q12_render_verdict", f"""
WITH p AS (SELECT vec_id, {PIXEL_SQL} AS s FROM embeddings WHERE vec_id % 17 <> 0),
t AS (SELECT vec_id, s, coalesce(list_max(list_transform(s, lambda x, i: CASE WHEN x <> s[-1] THEN i ELSE 0 END)), 0) AS last_other, list_stddev_pop(s) AS sd FROM p),
v AS (SELECT vec_id, CASE WHEN last_other = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(len(s) - last_other AS DOUBLE) / len(s) END AS tail, s[-1] AS fill, sd,
  CASE WHEN vec_id % 4 <> 0 THEN CAST(vec_id % 30 AS DOUBLE) END AS peer FROM t)
SELECT vec_id AS name, CASE WHEN tail >= 0.25 AND abs(fill - 128) <= 8 THEN 'TRUNCATED' WHEN sd < 2 AND peer IS NULL THEN 'UNJUDGED' ELSE 'FEATURELESS' END AS verdict,
  round(sd, 6) AS sd, peer AS peer_sd FROM v WHERE (tail >= 0.25 AND abs(fill - 128) <= 8) OR (sd < 2 AND (peer IS NULL OR peer > 15))""")
def q12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = table(spark, sf_dir, "embeddings")
    samples = vecs.select(F.col("vec_id").alias("name"), _pixels().alias("samples"))
    peers = vecs.filter("vec_id % 4 <> 0").select(
        F.col("vec_id").alias("name"), (F.col("vec_id") % 30).cast("double").alias("peer_sd")
    )
    allowed = vecs.filter("vec_id % 17 = 0").select(F.col("vec_id").alias("name"))
    found = vectors.render_verdict(samples, peers, allowed)
    return found.select("name", "verdict", F.round("sd", 6).alias("sd"), "peer_sd")


# --- whole jobs ---------------------------------------------------------------------------

@query("e2_backlog_report", BACKLOG_SQL + f""",
k AS (SELECT * FROM b WHERE lower(regexp_extract(path, '[^/]\\.([^./]*)$', 1)) IN ({_known_sql()})),
o AS (SELECT path, CASE WHEN stored THEN 'already' WHEN (ord + size) % 5 = 0 THEN 'failed' ELSE 'built' END AS outcome FROM k),
v AS (SELECT CASE WHEN NOT bool_or(outcome IN ('built', 'already')) THEN 'failed' WHEN bool_or(outcome = 'failed') THEN 'partial'
  WHEN bool_or(outcome = 'built') THEN 'built' ELSE 'already' END AS verdict FROM o GROUP BY path)
SELECT count(*) AS found, count(*) FILTER (WHERE verdict = 'built') AS built, count(*) FILTER (WHERE verdict = 'already') AS already,
  count(*) FILTER (WHERE verdict = 'partial') AS partial, count(*) FILTER (WHERE verdict = 'failed') AS failed, CAST(0 AS BIGINT) AS skipped FROM v""")
def e2(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = part_files(spark, sf_dir)
    outcome = F.when((F.col("ord") + F.col("size")) % 5 == 0, "failed").otherwise("built")
    return backlog_report(files, (90, 200, 700, 9000), _stored(spark, sf_dir, files), outcome)


VIEW_NAME = "'/v/' || doc_id || " + case_of("doc_id", [".txt", ".html", "", ".png", ".md"])


@query("e3_view_documents", r"""
WITH t AS (SELECT doc_id, '/v/' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.html' WHEN 2 THEN '' WHEN 3 THEN '.png' ELSE '.md' END AS path,
  CASE doc_id % 5 WHEN 4 THEN 'Markdown' WHEN 3 THEN 'Image' ELSE 'Text' END AS kind,
  CASE doc_id % 5 WHEN 1 THEN 'a ' || lang || ' & the' || chr(10) || CASE WHEN regexp_matches(text, '[^ \t\r\n]') THEN regexp_replace(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), '^ | $', '', 'g') || chr(10) ELSE '' END || 'The end'
    WHEN 3 THEN NULL ELSE text END AS text FROM documents)
SELECT path, kind, md5(text) AS digest, CAST((strlen(text) - strlen(replace(translate(text, 'THE', 'the'), 'the', ''))) // 3 AS INT) AS n_hits FROM t""")
def e3(spark: SparkSession, sf_dir: str) -> DataFrame:
    safe = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit("<p>a <b>"), "lang", F.lit("</b> &amp; the</p>\n<p>"), safe, F.lit("</p><p>The end</p>"))
    body = F.when(F.col("doc_id") % 5 == 1, page).otherwise(F.col("text"))
    files = table(spark, sf_dir, "documents").select(F.expr(VIEW_NAME).alias("path"), F.encode(body, "UTF-8").alias("content"))
    return view_documents(files, "the").select(
        "path", "kind", F.md5("text").alias("digest"), F.size("hits").alias("n_hits")
    )


GATE_SQL = f"""
WITH {RUNS_CTE}, m AS (SELECT name, ext, max(ms) AS ms, max(peer_ms) AS peer_ms FROM runs WHERE ord % 2 = 0 AND ms IS NOT NULL GROUP BY ALL),
w AS (SELECT name, greatest(min(ms), 0.001) AS was FROM runs WHERE ord % 2 = 1 AND ms IS NOT NULL GROUP BY 1),
g AS (SELECT name, avg(ms) AS ms, max(peer_ms) AS peer_ms FROM runs WHERE ord % 3 = 0 AND ms IS NOT NULL GROUP BY 1),
p AS (SELECT name, ms, peer_ms, round_even(ms / peer_ms * 100, 0) / 100 AS ratio, ext, row_number() OVER (PARTITION BY ext ORDER BY round_even(ms / peer_ms * 100, 0) / 100 DESC, name) AS rn
  FROM m WHERE peer_ms > 0 AND ms >= 25 AND ms - peer_ms >= 40),
s AS (SELECT 'peer' AS gate, name, ms, peer_ms AS ref, CASE ext WHEN 'avif' THEN 6.0::DOUBLE ELSE 3.0::DOUBLE END AS max_ratio FROM p WHERE rn = 1 AND ratio > CASE ext WHEN 'avif' THEN 6.0 ELSE 3.0 END
  UNION ALL SELECT 'self', m.name, ms, was, 2.5::DOUBLE FROM m JOIN w ON m.name = w.name WHERE ms >= 25 AND ms - was >= 40 AND round_even(ms / was * 100, 0) / 100 > 2.5),
c AS (SELECT gate, s.name, max_ratio, coalesce(g.ms, s.ms) AS now, CASE gate WHEN 'peer' THEN coalesce(g.peer_ms, ref) ELSE ref END AS ref FROM s LEFT JOIN g ON s.name = g.name)
SELECT gate, name, round_even(now / ref * 100, 0) / 100 AS ratio, max_ratio, reference,
  CASE WHEN moved > 0.2 THEN 'inconclusive' WHEN round_even(now / ref * 100, 0) / 100 > max_ratio AND now - ref >= 40 THEN 'confirmed' ELSE 'cleared' END AS verdict
FROM c, (SELECT 'ext' AS reference, max(abs(b - a) / greatest(a, b)) AS moved FROM
    (SELECT ext, avg(ms) FILTER (ord % 2 = 1) AS a, avg(ms) FILTER (ord % 2 = 0) AS b FROM runs WHERE ms IS NOT NULL GROUP BY ext) WHERE a <> 0 AND b <> 0
  UNION ALL SELECT 'name', max(abs(b - a) / greatest(a, b)) FROM
    (SELECT name, max(ms) FILTER (ord % 2 = 1) AS a, min(ms) FILTER (ord % 2 = 0) AS b FROM runs WHERE ms IS NOT NULL GROUP BY name) WHERE a <> 0 AND b <> 0)"""


@query("e4_performance_gate", GATE_SQL)
def e4(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = event_runs(spark, sf_dir).filter("ms IS NOT NULL")
    now = runs.filter("ord % 2 = 0").groupBy("name", "ext").agg(F.max("ms").alias("ms"), F.max("peer_ms").alias("peer_ms"))
    recorded = summaries.best_of_n(runs.filter("ord % 2 = 1"))
    again = runs.filter("ord % 3 = 0").groupBy("name").agg(F.avg("ms").alias("ms"), F.max("peer_ms").alias("peer_ms"))
    allowed = spark.createDataFrame([("avif", 6.0)], "ext string, max_ratio double")

    def moved(key: str, was: Column, is_: Column) -> DataFrame:
        before = runs.filter("ord % 2 = 1").groupBy(key).agg(was.alias("ms"))
        after = runs.filter("ord % 2 = 0").groupBy(key).agg(is_.alias("ms"))
        return summaries.worst_drift(before, after, key, "ms").withColumnRenamed("worst_drift", "drift")

    # The same suspects under two readings of how much the machine moved: means by kind, and single samples.
    by_ext, by_name = moved("ext", F.avg("ms"), F.avg("ms")), moved("name", F.max("ms"), F.min("ms"))
    gate = lambda drift, name: performance_gate(now, recorded, allowed, again, drift).withColumn("reference", F.lit(name))
    return gate(by_ext, "ext").unionByName(gate(by_name, "name"))
