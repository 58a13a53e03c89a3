"""Document jobs over the given tables."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import documents as D
from ..operators.picks import routed

from .derived import case_of
from .registry import query, table
from .scalar_queries import sql_hits
from .workflows import SQL_TEXT, SQL_VISIBLE, sql_entities

# --- HTML ---------------------------------------------------------------------------------


# Fragments that a cut at the first ``>`` or at the first ``<!--`` gets wrong, behind every page, and what they
# show: a comment opened inside a script, quoted ``>``, a quote that never closes, tags made by an omission.
HARD = (
    "'<p>a' || page_id || '</p><script>if(a<!--b){}</script><p>VISIBLE</p><h2 title=\"a>b\">H<b>1</b>"
    "<div>d</div><a title=''x>y'' href=''u' || page_id || '''>link</a> <a href=q>open <a data-href=n href=\"<b>\">in</a>"
    "<style a=\"</style>\">p{}</STYLE x>s<![x<b]>e <<!-- - -->i>t <b title=\"never' || '<br>5 < 6</p>'"
)
HARD_TEXT = (
    "chr(10) || 'a' || page_id || chr(10) || 'VISIBLE' || chr(10) || 'H1' || chr(10) || 'd' || chr(10) || 'link open inse <i>t "
    "<b title=\"never' || chr(10) || '5 < 6'"
)


@query("d1_html_text", f"""
WITH t AS (SELECT page_id, {SQL_TEXT} || {HARD_TEXT} AS text FROM pages)
SELECT page_id, md5(text) AS digest, CAST(length(text) AS BIGINT) AS chars FROM t""")
def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = table(spark, sf_dir, "pages").select("page_id", F.concat("html", F.expr(HARD)).alias("html"))
    return D.page_texts(hard, "page_id", "html").select(
        "page_id", F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("chars")
    )


# Pages with pictures and a table added at the end.
RICH = (
    "html || '<img src=\"/i' || page_id || '.png\" alt=\"A&amp;B\" width=\"250%\"><img alt=x><IMG SRC=b.gif width=12px>"
    "<table><tr><th>k</th><td>v<b>' || page_id || '</b></td></tr><tr><td>a  b</td></tr></table>'"
)


def _sql_inner(fragment: str) -> str:
    bare = sql_entities(f"regexp_replace({fragment}, '(?is)</?[a-z][^>]*>', '', 'g')")
    return f"trim(regexp_replace({bare}, '[ \\t\\r\\n]+', ' ', 'g'))"


@query("d2_html_elements", rf"""
WITH v AS (SELECT page_id, {SQL_VISIBLE.replace('html', '(' + RICH + ')', 1)} AS body FROM pages),
h AS (SELECT page_id, unnest(regexp_extract_all(body, '(?is)<(h[1-6]\b[^>]*>.*?)</h[1-6]\s*>', 1)) AS e, generate_subscripts(regexp_extract_all(body, '(?is)<(h[1-6]\b[^>]*>.*?)</h[1-6]\s*>', 1), 1) - 1 AS ord FROM v),
a AS (SELECT page_id, unnest(regexp_extract_all(body, '(?is)<a\b[^>]*>.*?</a\s*>')) AS e, generate_subscripts(regexp_extract_all(body, '(?is)<a\b[^>]*>.*?</a\s*>'), 1) - 1 AS ord FROM v)
SELECT page_id, 'heading' AS kind, CAST(ord AS INT) AS ord, CAST(e[2] AS INT) AS level, NULL AS target, {_sql_inner("regexp_replace(e, '(?is)^h[1-6][^>]*>', '')")} AS text, NULL AS width FROM h
UNION ALL SELECT page_id, 'link', CAST(ord AS INT), NULL, {sql_entities("regexp_extract(e, 'href=\"([^\"]*)\"', 1)")}, {_sql_inner('e')}, NULL FROM a
UNION ALL SELECT page_id, 'heading', (SELECT CAST(count(*) AS INT) FROM h WHERE h.page_id = pages.page_id), 2, NULL, 'H1', NULL FROM pages
UNION ALL SELECT page_id, 'link', CAST((SELECT count(*) FROM a WHERE a.page_id = pages.page_id) + i AS INT), NULL, CASE i WHEN 0 THEN 'u' || page_id WHEN 1 THEN 'q' ELSE '<b>' END,
  CASE i WHEN 0 THEN 'link' WHEN 1 THEN 'open' ELSE 'in' END, NULL FROM pages, (SELECT unnest([0, 1, 2]) AS i)
UNION ALL SELECT page_id, 'image', 0, NULL, '/i' || page_id || '.png', 'A&B', '100%' FROM pages
UNION ALL SELECT page_id, 'image', 1, NULL, 'b.gif', '', '12px' FROM pages
UNION ALL SELECT page_id, 'cell', 0, 0, NULL, 'k', NULL FROM pages UNION ALL SELECT page_id, 'cell', 1, 0, NULL, 'v' || page_id, NULL FROM pages
UNION ALL SELECT page_id, 'cell', 2, 1, NULL, 'a b', NULL FROM pages""")
def d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "pages").select("page_id", F.concat(F.expr(RICH), F.expr(HARD)).alias("html"))
    return D.html_elements(rich, "page_id", "html")


@query("d4_outline", rf"""
WITH v AS (SELECT page_id, html, {SQL_VISIBLE} AS body FROM pages),
h AS (SELECT page_id, unnest(regexp_extract_all(body, '(?is)<(h[1-6]\b[^>]*>.*?)</h[1-6]\s*>', 1)) AS e, generate_subscripts(regexp_extract_all(body, '(?is)<(h[1-6]\b[^>]*>.*?)</h[1-6]\s*>', 1), 1) - 1 AS ord FROM v)
SELECT v.page_id, true AS has_headings, regexp_matches(html, '(?i)<img') AND regexp_matches(html, '(?i)src=["'']?http') AS has_remote_images,
  CAST(ord AS INT) AS ord, CAST(e[2] AS INT) AS level, {_sql_inner("regexp_replace(e, '(?is)^h[1-6][^>]*>', '')")} AS text FROM v JOIN h ON v.page_id = h.page_id
UNION ALL SELECT page_id, true, regexp_matches(html, '(?i)<img') AND regexp_matches(html, '(?i)src=["'']?http'), (SELECT CAST(count(*) AS INT) FROM h WHERE h.page_id = v.page_id), 2, 'H1' FROM v""")
def d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = table(spark, sf_dir, "pages").select("page_id", F.concat("html", F.expr(HARD)).alias("html"))
    return D.outline(hard, "page_id", "html")


# --- Markdown -----------------------------------------------------------------------------

_NL = "chr(10)"
MARKDOWN = (
    f"'---' || {_NL} || 'title: d' || doc_id || {_NL} || '---' || {_NL} || '# Doc ' || doc_id || ' #' || {_NL} || {_NL}"
    f" || text || {_NL} || '- one' || {_NL} || '  - [x] two' || {_NL} || '3. [ ] three' || {_NL} || '```python' || {_NL} || '# not a heading' || {_NL} || doc_id || {_NL} || '```' || {_NL}"
    f" || '> said' || {_NL} || '***' || {_NL} || 'a | b' || {_NL} || '--- | :-:' || {_NL} || '1 | ' || doc_id || {_NL} || '![p](x.png)' || {_NL}"
    f" || 'Title ' || doc_id || {_NL} || '=====' || {_NL} || {_NL} || '    x = 1' || {_NL} || '    y' || {_NL} || '~~~' || {_NL} || 'open'"
)


@query("d3_md_blocks", rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
t AS (SELECT doc_id, i, CASE WHEN regexp_matches(line, '^ {{0,3}}#{{1,6}}([ \t]|$)') THEN 'heading' WHEN regexp_matches(line, '^ {{0,3}}(([*][ \t]*){{3,}}|(-[ \t]*){{3,}}|(_[ \t]*){{3,}})$') THEN 'rule'
  WHEN regexp_matches(line, '^ {{0,3}}>') THEN 'quote' WHEN regexp_matches(line, '^\s*([-*+]|[0-9]{{1,9}}[.)])[ \t]') THEN 'item' ELSE 'para' END AS kind,
  CASE WHEN regexp_matches(line, '^ {{0,3}}#{{1,6}}([ \t]|$)') THEN length(regexp_extract(line, '^ {{0,3}}(#{{1,6}})', 1)) WHEN regexp_matches(line, '^\s*([-*+]|[0-9]{{1,9}}[.)])[ \t]') THEN 1 END AS level, trim(line) AS text FROM l WHERE regexp_matches(line, '\S')),
f AS (SELECT doc_id, unnest([
  {{'i': -2, 'kind': 'front', 'level': NULL, 'text': 'title: d' || doc_id, 'lang': 'yaml', 'task': NULL}}, {{'i': -1, 'kind': 'heading', 'level': 1, 'text': 'Doc ' || doc_id, 'lang': NULL, 'task': NULL}},
  {{'i': 1000001, 'kind': 'item', 'level': 1, 'text': 'one', 'lang': NULL, 'task': NULL}}, {{'i': 1000002, 'kind': 'item', 'level': 2, 'text': 'two', 'lang': NULL, 'task': true}},
  {{'i': 1000003, 'kind': 'item', 'level': 1, 'text': 'three', 'lang': NULL, 'task': false}}, {{'i': 1000004, 'kind': 'code', 'level': NULL, 'text': '# not a heading' || chr(10) || doc_id, 'lang': 'py', 'task': NULL}},
  {{'i': 1000005, 'kind': 'quote', 'level': NULL, 'text': 'said', 'lang': NULL, 'task': NULL}}, {{'i': 1000006, 'kind': 'rule', 'level': NULL, 'text': '', 'lang': NULL, 'task': NULL}},
  {{'i': 1000007, 'kind': 'table', 'level': NULL, 'text': 'a | b' || chr(10) || '--- | :-:' || chr(10) || '1 | ' || doc_id, 'lang': NULL, 'task': NULL}}, {{'i': 1000008, 'kind': 'image', 'level': NULL, 'text': '![p](x.png)', 'lang': NULL, 'task': NULL}},
  {{'i': 1000009, 'kind': 'heading', 'level': 1, 'text': 'Title ' || doc_id, 'lang': NULL, 'task': NULL}}, {{'i': 1000010, 'kind': 'code', 'level': NULL, 'text': 'x = 1' || chr(10) || 'y', 'lang': 'plain', 'task': NULL}},
  {{'i': 1000011, 'kind': 'code', 'level': NULL, 'text': 'open', 'lang': 'plain', 'task': NULL}}], recursive := true) FROM documents),
u AS (SELECT doc_id, i, kind, level, text, NULL AS lang, NULL AS task FROM t UNION ALL SELECT doc_id, i, kind, level, text, lang, task FROM f)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS ord, kind, CAST(level AS INT) AS level, text, lang, task,
  CASE WHEN kind = 'table' THEN '[["a","b"],["1","' || doc_id || '"]]' END AS cells FROM u""")
def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(MARKDOWN).alias("md"))
    return D.md_rows(docs, "doc_id", "md").withColumn("cells", F.to_json("cells"))


@query("d3_md_outline", r"""
SELECT doc_id, CAST(1 AS INT) AS ord, CAST(1 AS INT) AS level, 'Doc ' || doc_id AS text FROM documents
UNION ALL SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '\S'))) + 10 AS INT), 1, 'Title ' || doc_id FROM documents""")
def d3_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(MARKDOWN).alias("md"))
    return D.md_outline(docs, "doc_id", "md")


# --- search -------------------------------------------------------------------------------

TERMS = ("The", "tion", "éa", "zzz-absent")


def _sql_doc_hits(table_name: str, key: str) -> str:
    parts = [f"SELECT {key}, '{term}' AS term, off, rank, n FROM {sql_hits(table_name, key, term)}" for term in TERMS]
    return " UNION ALL ".join(parts)


@query("d5_doc_search", f"""
WITH h AS ({_sql_doc_hits('documents', 'doc_id')})
SELECT doc_id, term, CAST(rank AS INT) AS rank, CAST(n AS INT) AS n_hits, off AS "offset", rank || '/' || n AS label,
  coalesce(lead(off) OVER w, first_value(off) OVER w) AS next_offset,
  coalesce(lag(off) OVER w, last_value(off) OVER (PARTITION BY doc_id, term ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS previous_offset
FROM h WINDOW w AS (PARTITION BY doc_id, term ORDER BY off)""")
def d5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.doc_search(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS)


@query("d5_term_table", f"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{{4,}}')) AS term FROM benchmark),
p AS (SELECT doc_id, translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents),
h AS (SELECT doc_id, term, string_split(t, translate(term, '{string.ascii_uppercase}', '{string.ascii_lowercase}')) AS parts FROM p, w
  WHERE contains(t, translate(term, '{string.ascii_uppercase}', '{string.ascii_lowercase}')))
SELECT doc_id, term, len(parts) - 1 AS n_hits, CAST(strlen(parts[1]) AS BIGINT) AS first_hit,
  CAST(list_sum(list_transform(parts[1:len(parts) - 1], lambda x: strlen(x))) + (len(parts) - 2) * strlen(term) AS BIGINT) AS last_hit FROM h""")
def d5_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the benchmark looked up in every document."""
    words = F.regexp_extract_all("text", F.lit("([A-Za-z]{4,})"), F.lit(1))
    terms = table(spark, sf_dir, "benchmark").select(F.explode(words).alias("term"))
    hits = D.doc_hits(table(spark, sf_dir, "documents"), "doc_id", "text", terms)
    return hits.select(
        "doc_id", "term", F.size("hits").cast("bigint").alias("n_hits"), F.get("hits", F.lit(0)).alias("first_hit"),
        F.element_at("hits", -1).alias("last_hit"),
    )


@query("w9_find_position", f"""
WITH h AS ({_sql_doc_hits('documents', 'doc_id')}), g AS (SELECT doc_id, term, max(n) AS n, min(rank) FILTER (WHERE off >= doc_id % 300) AS later FROM h GROUP BY ALL)
SELECT doc_id, term, CAST(coalesce(later, 1) AS INT) AS position, CAST(n AS INT) AS n_hits FROM g""")
def w9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a search resumes when the reader is already some way into the text."""
    docs = table(spark, sf_dir, "documents")
    hits = D.doc_hits(docs, "doc_id", "text", TERMS)
    return hits.select(
        "doc_id", "term", D.resume_hit(F.col("hits"), F.col("doc_id") % 300).alias("position"),
        F.size("hits").alias("n_hits"),
    )


CONV_PAGES_SQL = """
WITH p AS (SELECT conv_id, turn, sum(strlen(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS next_start, strlen(text) + 1 AS w, text FROM conversations),
s AS (SELECT conv_id, turn, CAST(next_start - w AS BIGINT) AS start, CAST(next_start AS BIGINT) AS next_start, text FROM p)
"""


@query("j9_page_starts", CONV_PAGES_SQL + "SELECT conv_id, turn, start, next_start FROM s")
def j9_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.page_starts(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("j9_hit_to_page", CONV_PAGES_SQL + """,
o AS (SELECT conv_id, unnest(range(0, max(next_start), 61)) AS off FROM s GROUP BY conv_id)
SELECT o.conv_id, o.off AS "offset", s.turn, o.off - s.start AS page_offset FROM o ASOF JOIN s ON o.conv_id = s.conv_id AND o.off >= s.start""")
def j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = D.page_starts(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    ends = starts.groupBy("conv_id").agg(F.max("next_start").alias("end"))
    offsets = ends.select(
        "conv_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("end") - 1, F.lit(61).cast("bigint"))).alias("offset")
    )
    return D.hit_to_page(offsets, starts, "conv_id", "turn")


@query("d5_conversation_search", CONV_PAGES_SQL + f""",
h AS {sql_hits('conversations', 'conv_id, turn', 'the')}
SELECT s.conv_id, s.turn, start + off AS "offset", off AS page_offset FROM s JOIN h ON s.conv_id = h.conv_id AND s.turn = h.turn""")
def d5_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits as offsets into the whole conversation, mapped back to the turn that holds them."""
    pages = table(spark, sf_dir, "conversations")
    starts = D.page_starts(pages, "conv_id", "turn", "text")
    local = D.doc_hits(
        pages.withColumn("page", F.struct("conv_id", "turn")), "page", "text", ["the"]
    ).select("page.conv_id", "page.turn", F.explode("hits").alias("local"))
    hits = local.join(starts, ["conv_id", "turn"]).select(
        "conv_id", (F.col("start") + F.col("local")).alias("offset")
    )
    return D.hit_to_page(hits, starts, "conv_id", "turn")


@query("d6_keyword_search", """
WITH t AS (SELECT unnest(['red', 'brand#1', 'promo', 'zz']) AS term),
m AS (SELECT term, p_partkey, row_number() OVER (PARTITION BY term ORDER BY p_partkey) AS position FROM t JOIN part
  ON contains(lower(p_name), term) OR contains(lower(p_brand), term) OR contains(lower(p_type), term))
SELECT term, CAST(position AS INT) AS position, p_partkey FROM m WHERE position <= 12""")
def d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.keyword_search(
        table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"),
        [" Red ", "brand#1", "PROMO", "x", "zz"], ord_="p_partkey", columns=["p_name", "p_brand", "p_type"],
    )
    return found.select("term", "position", "p_partkey")


@query("f15_doc_links", """
SELECT page_id, CAST(i - 1 AS INT) AS ord, CASE i WHEN 1 THEN url ELSE 'www.s' || page_id || '.org/a' END AS text,
  CASE i WHEN 1 THEN url ELSE 'https://www.s' || page_id || '.org/a' END AS href FROM pages, (SELECT unnest([1, 2]) AS i)""")
def doc_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("'see ' || url || ' and (www.s' || page_id || '.org/a).'")
    pages = table(spark, sf_dir, "pages").select("page_id", text.alias("text"))
    return D.doc_links(pages, "page_id", "text")


@query("p13_contacts", r"""
WITH t AS (SELECT doc_id, string_split_regex(text || ' ' || lang || '.' || doc_id || '@mail' || (doc_id % 7) || '.example.com; not@this', '\s+') AS p FROM documents),
u AS (SELECT doc_id, unnest(p) AS v, generate_subscripts(p, 1) - 1 AS pos FROM t),
c AS (SELECT doc_id, pos, regexp_replace(v, '^[("''<\[]+|[)"''>\],;:.!?]+$', '', 'g') AS value FROM u WHERE contains(v, '@'))
SELECT doc_id, CAST(pos AS INT) AS pos, value FROM c WHERE strlen(value) BETWEEN 6 AND 120 AND regexp_matches(value, '^[!#$%&''*+.0-9=?A-Z^_`a-z|~-]{1,64}@[^@()\[\]{},;:"<>\\/ ]+$')
  AND NOT regexp_matches(value, '@-|-$|@\.|\.\.') AND regexp_matches(value, '@.+\.[A-Za-z]{2,}$') AND NOT regexp_matches(value, '[^!-~]')""")
def p13_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("text || ' ' || lang || '.' || doc_id || '@mail' || (doc_id % 7) || '.example.com; not@this'")
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return D.contacts(docs, "doc_id", "text")


SECRET_TEXT = (
    "text || ' key=ghp_' || left(md5(text) || md5(source), 36) || '; ' || CASE doc_id % 3 WHEN 0 THEN 'AKIA' || left(upper(md5(text)), 16) "
    "WHEN 1 THEN '-----BEGIN RSA PRIVATE KEY-----' ELSE 'ghp_short' END"
)


@query("p14_secrets", """
SELECT doc_id, 'ghp_' || left(md5(text) || md5(source), 36) AS token, 'repo_token' AS kind FROM documents
UNION ALL SELECT doc_id, 'AKIA' || left(upper(md5(text)), 16), 'cloud_key_id' FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, NULL, 'private_key' FROM documents WHERE doc_id % 3 = 1""")
def p14_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(SECRET_TEXT).alias("text"))
    return D.secrets(docs, "doc_id", "text")


# --- JSON ---------------------------------------------------------------------------------

_AKIA = "'\"AKIA' || left(upper(md5(props || event_id)), 16) || '\"'"
JSON_DOC = (
    "CASE event_id % 6 WHEN 0 THEN '{\"k\": 1, \"zz\": \"ghp_' || left(md5(props) || md5(event_type), 36) || '\"}' "
    f"WHEN 1 THEN '{{\"auth\": {{\"deep\": [\"x\", {{\"t\": ' || {_AKIA} || '}}]}}}}' "
    f"WHEN 2 THEN '{{\"a\": {{\"b\": {{\"c\": {{\"d\": {{\"e\": ' || {_AKIA} || '}}}}}}}}}}' "
    f"WHEN 3 THEN '{{\"a\": {{\"b\": {{\"c\": {{\"d\": {{\"e\": {{\"f\": ' || {_AKIA} || '}}}}}}}}}}}}' "
    "WHEN 4 THEN props ELSE '{\"b\": \"sk-' || md5(props) || '\", \"a\": [\"none\", \"ghp_' || left(md5(props) || md5(event_type), 36) || '\"]}' END"
)


@query("p15_secret_in_json", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'zz' WHEN 1 THEN 'auth' ELSE 'a' END AS top_key,
  CASE WHEN event_id % 6 IN (0, 5) THEN 'repo_token' ELSE 'cloud_key_id' END AS kind FROM events WHERE event_id % 6 NOT IN (3, 4)""")
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "events").select("event_id", F.expr(JSON_DOC).alias("doc"))
    return D.secrets_in_json(docs, "event_id", "doc")


@query("p16_oversize_docs", """
WITH j AS (SELECT doc_id, json_object('lang', lang, 'body', text, 'title', left(text, 40), 'id', doc_id) AS doc, text FROM documents)
SELECT doc_id, CAST(strlen(doc) AS BIGINT) AS bytes, 'body' AS largest_key, CAST(strlen(json_object('b', text)) - 6 AS BIGINT) AS largest_bytes FROM j WHERE strlen(doc) > 4000""")
def p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.to_json(F.struct(
        "lang", F.col("text").alias("body"), F.substring("text", 1, 40).alias("title"), F.col("doc_id").alias("id")
    ))
    docs = table(spark, sf_dir, "documents").select("doc_id", doc.alias("doc"))
    return D.oversize_docs(docs, "doc_id", "doc", limit=4000)


SETTINGS_DOC = (
    "'{\"Width\": ' || (event_id * 700000 - 5) || ', \"Name\": \"' || event_type || '\", \"Big\": ' || (4294967290 + event_id % 12) || "
    "', \"Flag\": ' || CASE WHEN event_id % 2 = 0 THEN '\"5\"' ELSE '5' END || ', \"Ratio\": 1.5, \"Other\": 1' || CASE WHEN event_id % 3 = 0 THEN ', \"Title\": 7' ELSE '' END || '}'"
)
ALLOWED = {"Width": "dword", "Name": "text", "Big": "dword", "Flag": "dword", "Ratio": "dword", "Title": "text"}


@query("p17_typed_settings", """
SELECT event_id, 'Width' AS name, 'dword' AS kind, CAST(event_id * 700000 - 5 AS VARCHAR) AS value, event_id * 700000 - 5 BETWEEN 0 AND 4294967295 AS applied FROM events
UNION ALL SELECT event_id, 'Name', 'text', event_type, true FROM events
UNION ALL SELECT event_id, 'Big', 'dword', CAST(4294967290 + event_id % 12 AS VARCHAR), event_id % 12 <= 5 FROM events
UNION ALL SELECT event_id, 'Flag', 'dword', '5', event_id % 2 <> 0 FROM events
UNION ALL SELECT event_id, 'Ratio', 'dword', '1.5', false FROM events
UNION ALL SELECT event_id, 'Title', 'text', '7', false FROM events WHERE event_id % 3 = 0""")
def p17(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "events").select("event_id", F.expr(SETTINGS_DOC).alias("doc"))
    return D.typed_settings(docs, "event_id", "doc", ALLOWED)


# --- media and routing --------------------------------------------------------------------

MEDIA_EXT = case_of("p_partkey", ["jpg", "mp3", "mkv"])
MEDIA = {
    "path": f"'/m/' || p_partkey || '.' || {MEDIA_EXT}",
    "width": "CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size * 10 END", "height": "p_size + 1",
    "make": "CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END", "model": "CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE p_type END",
    "bit_depth": "p_size % 3 * 8", "dpi_x": "CAST(p_size * 10 AS DOUBLE)", "dpi_y": "CAST(0 AS DOUBLE)", "res_unit": "2",
    "lat_d": "CAST(p_size AS DOUBLE)", "lat_m": "CAST(30 AS DOUBLE)", "lat_s": "CAST(0 AS DOUBLE)", "lat_ref": "CASE WHEN p_partkey % 2 = 0 THEN 'S' ELSE 'N' END",
    "lon_d": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END", "lon_m": "CAST(15 AS DOUBLE)", "lon_s": "CAST(0 AS DOUBLE)", "lon_ref": "'E'",
    "artist": "p_name", "album": "''", "title": "p_name || p_partkey", "genre": "NULL", "track": "p_partkey % 3", "year": "0",
    "duration_ms": "p_size * 1000", "bitrate_kbps": "p_size",
}


@query("d7_media_props", f"""
WITH m AS (SELECT p_partkey, {', '.join(f'{e} AS {n}' for n, e in MEDIA.items())} FROM part)
SELECT path, 'Image.Dimensions' AS key, width || ' x ' || height AS value FROM m WHERE width > 0
UNION ALL SELECT path, 'Image.HorizontalSize', CAST(width AS VARCHAR) FROM m WHERE width > 0
UNION ALL SELECT path, 'Image.VerticalSize', CAST(height AS VARCHAR) FROM m WHERE width > 0
UNION ALL SELECT path, 'Video.FrameWidth', CAST(width AS VARCHAR) FROM m WHERE width > 0 AND path LIKE '%.mkv'
UNION ALL SELECT path, 'Video.FrameHeight', CAST(height AS VARCHAR) FROM m WHERE width > 0 AND path LIKE '%.mkv'
UNION ALL SELECT path, 'Photo.CameraManufacturer', make FROM m WHERE make <> ''
UNION ALL SELECT path, 'Photo.CameraModel', model FROM m WHERE model IS NOT NULL
UNION ALL SELECT path, 'Image.BitDepth', CAST(bit_depth AS VARCHAR) FROM m WHERE bit_depth > 0
UNION ALL SELECT path, 'Image.HorizontalResolution', CAST(dpi_x AS VARCHAR) FROM m
UNION ALL SELECT path, 'GPS.LatitudeDecimal', CAST(CASE WHEN lat_ref = 'S' THEN -1 ELSE 1 END * (lat_d + 0.5) AS VARCHAR) FROM m WHERE lon_d IS NOT NULL
UNION ALL SELECT path, 'GPS.LongitudeDecimal', CAST(lon_d + 0.25::DOUBLE AS VARCHAR) FROM m WHERE lon_d IS NOT NULL
UNION ALL SELECT path, 'Music.Artist', artist FROM m UNION ALL SELECT path, 'Title', title FROM m
UNION ALL SELECT path, 'Music.TrackNumber', CAST(track AS VARCHAR) FROM m WHERE track > 0
UNION ALL SELECT path, 'Media.Duration', CAST(CAST(duration_ms AS BIGINT) * 10000 AS VARCHAR) FROM m
UNION ALL SELECT path, 'Audio.EncodingBitrate', CAST(bitrate_kbps * 1000 AS VARCHAR) FROM m""")
def d7(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = table(spark, sf_dir, "part").selectExpr(*[f"{e} AS {n}" for n, e in MEDIA.items()])
    return D.media_props(media.withColumn("genre", F.col("genre").cast("string")))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    key = F.col("c_custkey")
    return joined.select(
        key.alias("ord"), F.concat(F.lit("/in/track"), (key % 20).cast("string"), F.lit(".mp3")).alias("path"),
        F.when(key % 7 != 0, F.col("n_name")).otherwise(" / ").alias("artist"), F.col("c_mktsegment").alias("album"),
        F.lit(None).cast("string").alias("title"), (key % 20).cast("int").alias("track"),
    )


ROUTE_SQL = """
WITH t AS (SELECT c_custkey AS ord, '/in/track' || (c_custkey % 20) || '.mp3' AS path, 'track' || (c_custkey % 20) AS stem,
  CASE WHEN c_custkey % 7 = 0 THEN '' ELSE n_name || '/' END || c_mktsegment AS rel FROM customer JOIN nation ON c_nationkey = n_nationkey),
r AS (SELECT *, row_number() OVER (PARTITION BY rel, stem ORDER BY ord) AS rk FROM t)
"""


@query("d8_route_plan", ROUTE_SQL + """
SELECT ord, path, '/out/' || rel || '/' || stem || CASE WHEN rk = 1 THEN '' ELSE ' (' || rk || ')' END || '.mp3' AS destination, 'rename' AS action FROM r""")
def d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.route_plan(D.tag_routes(_tagged(spark, sf_dir), "$artist/$album", "/out"))


@query("d8_dimension_routes", """
SELECT (SELECT count(*) FROM part WHERE p_partkey % 9 <> 0) AS done, (SELECT count(*) FROM part WHERE p_partkey % 9 = 0) AS skipped""")
def d8_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = F.when(F.col("p_partkey") % 9 != 0, F.col("p_size"))
    files = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"), F.concat(F.lit("/pics/"), "p_name", F.lit(".png")).alias("path"),
        width.alias("width"), F.lit(600).alias("height"),
    )
    return routed(D.route_plan(D.dimension_routes(files)))


@query("d9_page_manifest", """
WITH p AS (SELECT conv_id, turn, 'scan' || (turn * 7 % 11) || '.png' AS path FROM conversations)
SELECT conv_id, turn, path, row_number() OVER (PARTITION BY conv_id ORDER BY turn * 7 % 11, path) - 1 AS page, count(*) OVER (PARTITION BY conv_id) AS page_count,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn * 7 % 11, path) = 1 AS is_cover FROM p""")
def d9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "'scan' || (turn * 7 % 11) || '.png' AS path")
    return D.page_manifest(pages, "conv_id", "path")
