"""Picks, plans, orderings and archives over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import limits, picks, summaries
from ..operators.ordering import natural_key, natural_order
from .derived import ENTRIES_CTE, FILES_CTE, line_entries, part_files
from .registry import query, table

# Natural sort key in plain SQL: digit runs as (length, digits), other runs as they are.
SQL_NATURAL = (
    r"list_transform(regexp_extract_all(lower({0}), '(\d+|\D+)'), lambda t: CASE WHEN regexp_matches(t, '^\d') "
    r"THEN lpad(CAST(length(ltrim(t, '0')) AS VARCHAR), 6, '0') || ltrim(t, '0') ELSE t END)"
)

ENTRIES_SQL = f"WITH {ENTRIES_CTE}"
CANDIDATES_SQL = ENTRIES_SQL + r""",
c AS (SELECT *, lower(regexp_extract(name, '([^/\\]*)$', 1)) AS base FROM entries),
k AS (SELECT *, regexp_extract(base, '([^.]*)$', 1) AS ext, contains(base, 'cover') AS cover,
  contains(base, 'credit') OR contains(base, 'logo') OR contains(base, 'recruit') OR contains(base, 'invite') AS credit FROM c
  WHERE NOT is_dir AND size BETWEEN 1 AND 33554432 AND NOT contains(name, '__MACOSX') AND base <> 'thumbs.db'),
i AS (SELECT *, ext IN ('jp2', 'j2k', 'jpf', 'jpx', 'jpm') AS exotic FROM k WHERE ext IN ('bmp', 'gif', 'jpg', 'jpeg', 'png', 'tif', 'tiff', 'webp', 'jp2')),
s1 AS (SELECT *, bool_or(NOT credit) OVER (PARTITION BY archive_id) AS any_clean FROM i),
f1 AS (SELECT * FROM s1 WHERE NOT credit OR NOT any_clean),
s2 AS (SELECT *, bool_or(NOT exotic) OVER (PARTITION BY archive_id) AS any_native FROM f1),
f2 AS (SELECT * FROM s2 WHERE NOT exotic OR NOT any_native),
r AS (SELECT archive_id, ord, name, size, row_number() OVER (PARTITION BY archive_id ORDER BY cover DESC, """ + SQL_NATURAL.format("replace(name, '[', '{')") + """, ord) AS rank FROM f2),
p AS (SELECT * FROM r WHERE rank <= 4)
"""


@query("w1_pick_covers", CANDIDATES_SQL + "SELECT archive_id, CAST(rank AS INT) AS rank, name, size FROM p")
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picks.pick_covers(line_entries(spark, sf_dir), 4).select("archive_id", "rank", "name", "size")


@query("w1_pick_one", CANDIDATES_SQL + "SELECT archive_id, name, size FROM p WHERE rank = 1")
def w1_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picks.pick_covers(line_entries(spark, sf_dir), 1).select("archive_id", "name", "size")


@query("w2_budgeted_pick", CANDIDATES_SQL + """,
q AS (SELECT archive_id, rank, name, CAST(size // 8 AS BIGINT) AS size FROM p),
g AS (SELECT archive_id, coalesce(max(size) FILTER (WHERE rank = 1), 0) AS s1, coalesce(max(size) FILTER (WHERE rank = 2), 0) AS s2,
  coalesce(max(size) FILTER (WHERE rank = 3), 0) AS s3, coalesce(max(size) FILTER (WHERE rank = 4), 0) AS s4 FROM q GROUP BY 1),
l1 AS (SELECT *, CASE WHEN s1 <= 8388608 THEN 8388608 - s1 ELSE 8388608 END AS a1 FROM g),
l2 AS (SELECT *, CASE WHEN s2 <= a1 THEN a1 - s2 ELSE a1 END AS a2 FROM l1),
l3 AS (SELECT *, CASE WHEN s3 <= a2 THEN a2 - s3 ELSE a2 END AS a3 FROM l2)
SELECT q.archive_id, CAST(rank AS INT) AS rank, name, size FROM q JOIN l3 ON q.archive_id = l3.archive_id
WHERE size <= CASE rank WHEN 1 THEN 8388608 WHEN 2 THEN a1 WHEN 3 THEN a2 ELSE a3 END""")
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = picks.pick_covers(line_entries(spark, sf_dir), 4).withColumn("size", F.expr("size div 8"))
    return picks.budgeted_pick(chosen, 4).select("archive_id", "rank", "name", "size")


@query("w3_retain_recent", """
WITH p AS (SELECT user_id, event_type || '-' || (event_id % 40) AS key, event_id AS "at", CAST(value * 1000000 AS BIGINT) AS size, event_id % 4 = 0 AS is_full FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id, key ORDER BY is_full DESC, "at" DESC) AS k FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "at" DESC) AS position, sum(size) OVER (PARTITION BY user_id ORDER BY "at" DESC) AS running_bytes FROM l WHERE k = 1)
SELECT user_id, key, "at", size, is_full, CAST(position AS INT) AS position, CAST(running_bytes AS BIGINT) AS running_bytes FROM n
WHERE position <= 16 AND running_bytes <= 402653184""")
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    puts = table(spark, sf_dir, "events").selectExpr(
        "user_id", "event_type || '-' || (event_id % 40) AS key", "event_id AS at",
        "CAST(round(value * 1000000) AS BIGINT) AS size", "event_id % 4 = 0 AS is_full",
    )
    return picks.retain_recent(puts, "user_id")


@query("w4_dedupe_by_name", CANDIDATES_SQL + """,
d AS (SELECT archive_id, regexp_replace(name, '^.*/', '') AS name, size, rank, row_number() OVER (PARTITION BY archive_id, regexp_replace(name, '^.*/', '') ORDER BY rank) AS k FROM p)
SELECT archive_id, name, size, CAST(rank AS INT) AS rank FROM d WHERE k = 1""")
def w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = picks.pick_covers(line_entries(spark, sf_dir), 4)
    bare = chosen.select("archive_id", F.regexp_replace("name", "^.*/", "").alias("name"), "size", "rank")
    return picks.dedupe_by_name(bare).select("archive_id", "name", "size", "rank")


# Move every part file into one of five folders under its part name: many collisions.
RENAME_SQL = f"""
WITH {FILES_CTE}, q AS (SELECT ord, path, regexp_extract(path, '^.+\\.([^.]*)$', 1) AS ext,
  CASE WHEN ord % 6 = 0 THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '/lib/brand#' || ord % 5 END AS folder,
  CASE WHEN ord % 6 = 0 THEN regexp_extract(path, '([^/]*)\\.[^.]*$', 1) ELSE regexp_extract(path, '/([A-Za-z]+)_[^/]*$', 1) END AS base FROM files),
a AS (SELECT *, folder || '/' || base || '.' || ext AS plain FROM q),
t AS (SELECT *, lower(plain) AS slot, lower(plain) = lower(path) AS stay FROM a),
x AS (SELECT DISTINCT path FROM (SELECT path FROM t WHERE stay
  UNION ALL SELECT folder || '/' || base || CASE WHEN ord % 4 = 0 THEN '' ELSE ' (' || (2 + ord % 9) || ')' END || '.' || ext FROM t WHERE ord % 7 = 0)),
n AS (SELECT DISTINCT slot, k FROM (SELECT lower(path) AS slot, 1 AS k FROM x
  UNION ALL SELECT lower(regexp_replace(path, ' \\(\\d+\\)', '')), CAST(regexp_extract(path, ' \\((\\d+)\\)', 1) AS BIGINT) FROM x WHERE regexp_matches(path, ' \\(\\d+\\)\\.'))),
w AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY ord) AS rk, count(*) OVER (PARTITION BY slot) AS c FROM t WHERE NOT stay),
f AS (SELECT slot, k, row_number() OVER (PARTITION BY slot ORDER BY k) AS rk FROM (
  SELECT slot, unnest(range(1, max_k + 1)) AS k FROM (SELECT slot, max(c) + coalesce((SELECT count(*) FROM n WHERE n.slot = w.slot), 0) AS max_k FROM w GROUP BY slot))
  WHERE (slot, k) NOT IN (SELECT (slot, k) FROM n))
SELECT ord, path, CASE WHEN f.k = 1 THEN plain ELSE folder || '/' || base || ' (' || f.k || ').' || ext END AS destination, 'rename' AS action
FROM w JOIN f ON w.slot = f.slot AND w.rk = f.rk
UNION ALL SELECT ord, path, path, 'in_place' FROM t WHERE stay"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("ord") % 6 == 0
    files = part_files(spark, sf_dir)
    return files.select(
        "ord", "path",
        F.when(own, F.regexp_extract("path", "^(.*)/[^/]*$", 1))
        .otherwise(F.concat(F.lit("/lib/brand#"), (F.col("ord") % 5).cast("string"))).alias("folder"),
        F.when(own, F.regexp_extract("path", r"([^/]*)\.[^.]*$", 1))
        .otherwise(F.regexp_extract("path", "/([A-Za-z]+)_[^/]*$", 1)).alias("base"),
    )


@query("w5_rename_plan", RENAME_SQL)
def w5(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _requests(spark, sf_dir)
    suffix = F.when(F.col("ord") % 4 == 0, "").otherwise(
        F.concat(F.lit(" ("), (2 + F.col("ord") % 9).cast("string"), F.lit(")"))
    )
    ext = F.regexp_extract("path", r"([^.]*)$", 1)
    existing = requests.filter("ord % 7 = 0").select(
        F.concat("folder", F.lit("/"), "base", suffix, F.lit("."), ext).alias("path")
    )
    return picks.rename_plan(requests, existing)


@query("w5_batch_outputs", rf"""
WITH {FILES_CTE}, s AS (SELECT ord, path, regexp_extract(path, '/([^/]*)\.[^.]*$', 1) AS stem FROM files),
r AS (SELECT *, row_number() OVER (PARTITION BY lower(stem) ORDER BY ord) AS rk FROM s)
SELECT ord, path, '/out/' || stem || CASE WHEN rk = 1 THEN '' ELSE ' (' || (rk - 1) || ')' END || '.png' AS destination FROM r""")
def w5_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picks.batch_output_plan(part_files(spark, sf_dir).select("ord", "path"), "png", "/out")


@query("w6_neighbours", f"""
WITH {FILES_CTE}, d AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, path || '#' || ord AS path FROM files),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY {SQL_NATURAL.format("regexp_extract(path, '([^/]*)$', 1)")}, path) AS position, count(*) OVER (PARTITION BY folder) AS n FROM d),
l AS (SELECT folder, list(path ORDER BY position) AS l FROM o GROUP BY folder)
SELECT o.folder, position, n, path, l[position % n + 1] AS next_path, l[(position + 1) % n + 1] AS ahead_2, l[(position + 2) % n + 1] AS ahead_3,
  l[(position - 2 + n) % n + 1] AS previous_path FROM o JOIN l ON o.folder = l.folder""")
def w6(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = part_files(spark, sf_dir).select(
        F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"),
        F.concat("path", F.lit("#"), F.col("ord").cast("string")).alias("path"),
    )
    return picks.neighbours(files, "folder", "path")


@query("w7_numbered_rows", "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_no FROM orders")
def w7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return picks.numbered_rows(rows, [F.col("o_totalprice"), F.col("o_orderkey")]).drop("o_totalprice")


@query("w7_numbered_rows_sliced", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_no FROM orders")
def w7_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same numbering, forced onto the path that cuts a hot group into slices."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return picks.numbered_rows(
        rows, [F.col("o_totalprice"), F.col("o_orderkey")]
    ).drop("o_totalprice")


@query("w10_latest_generation", """
SELECT user_id, event_id, event_id % 50 AS generation, event_type FROM events e
WHERE event_id % 50 = (SELECT max(event_id % 50) FROM events l WHERE l.user_id = e.user_id)""")
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "events").select(
        "user_id", "event_id", (F.col("event_id") % 50).alias("generation"), "event_type"
    )
    return picks.latest_generation(results, "user_id", "generation")


@query("a3_archive_totals", ENTRIES_SQL + """
SELECT archive_id, count(*) FILTER (WHERE NOT is_dir) AS files, CAST(sum(size) AS BIGINT) AS total_bytes FROM entries GROUP BY 1""")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.archive_totals(line_entries(spark, sf_dir))


@query("a13_best_picture", ENTRIES_SQL + """,
p AS (SELECT archive_id, ord, ord // 1000000000000 - 1 AS picture_type, size, CASE ord // 1000000000000 - 1 WHEN 3 THEN 0 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 3 ELSE 2 END AS rank FROM entries),
r AS (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY rank, size DESC, ord) AS k FROM p)
SELECT archive_id, ord, picture_type, size FROM r WHERE k = 1""")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    pictures = line_entries(spark, sf_dir).withColumn("picture_type", F.expr("ord div 1000000000000 - 1"))
    return summaries.best_picture(pictures, "archive_id")


@query("l1_natural_order", f"""
WITH n AS (SELECT c_custkey, 'dir/' || CASE c_custkey % 3 WHEN 0 THEN 'Page' WHEN 1 THEN 'page' ELSE 'p' END || (c_custkey * 7919 % 1500) || CASE WHEN c_custkey % 4 = 0 THEN 'b02' ELSE '' END AS path FROM customer)
SELECT path, row_number() OVER (ORDER BY {SQL_NATURAL.format("regexp_extract(path, '([^/]*)$', 1)")}, path, c_custkey) AS position FROM n""")
def l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "'dir/' || CASE c_custkey % 3 WHEN 0 THEN 'Page' WHEN 1 THEN 'page' ELSE 'p' END || (c_custkey * 7919 % 1500) "
        "|| CASE WHEN c_custkey % 4 = 0 THEN 'b02' ELSE '' END AS path",
    )
    key = natural_key(F.regexp_extract("path", "([^/]*)$", 1))
    numbered = picks.numbered_rows(
        paths.withColumn("_k", key), [F.col("_k"), F.col("path"), F.col("c_custkey")], "position"
    )
    return natural_order(numbered.select("path", "position"), "path")


@query("l2_listing_order", ENTRIES_SQL + """
SELECT archive_id, ord, name, is_dir, row_number() OVER (ORDER BY is_dir DESC, lower(name), name, archive_id, ord) AS position FROM entries""")
def l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = line_entries(spark, sf_dir).select("archive_id", "ord", "name", "is_dir")
    order = [F.col("is_dir").desc(), F.lower("name"), F.col("name"), F.col("archive_id"), F.col("ord")]
    return limits.listing_order(picks.numbered_rows(entries, order, "position"))
