"""Column functions and predicates over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as C
from ..functions import media, paths, signatures, sizes, text as T
from ..functions.encoding import decode_text, text_encoding
from ..sources.files import supported_only
from .derived import FILES_CTE, case_of, part_files
from .registry import query, table


def _in(exts) -> str:
    return ", ".join(f"'{e}'" for e in exts)


def sql_category(ext: str) -> str:
    lists = (
        ("Ebook", C.EBOOK_EXTS), ("Document", C.DOCUMENT_EXTS), ("Audio", C.AUDIO_EXTS),
        ("Raw", C.RAW_EXTS), ("Video", C.VIDEO_EXTS), ("Archive", C.ARCHIVE_EXTS),
    )
    return "CASE " + " ".join(f"WHEN {ext} IN ({_in(e)}) THEN '{n}'" for n, e in lists) + " ELSE 'Image' END"


SQL_EXT = r"lower(regexp_extract(path, '[^/\\]\.([^./\\]*)$', 1))"
SQL_KNOWN = _in(sorted(paths.DEFAULT_KNOWN))


def sql_sized(b: str) -> str:
    return (
        f"CASE WHEN {b} < 1024 THEN {b} || ' B' "
        f"WHEN {b} < 1048576 THEN printf('%.1f KB', CAST({b} AS DOUBLE) / 1024) "
        f"WHEN {b} < 1073741824 THEN printf('%.1f MB', CAST({b} AS DOUBLE) / 1048576) "
        f"WHEN {b} < 1099511627776 THEN printf('%.1f GB', CAST({b} AS DOUBLE) / 1073741824) "
        f"ELSE printf('%.1f TB', CAST({b} AS DOUBLE) / 1099511627776) END"
    )


# --- predicates over files ----------------------------------------------------------------

@query("p1_with_category", f"WITH {FILES_CTE} SELECT path, {SQL_EXT} AS ext, {sql_category(SQL_EXT)} AS category FROM files")
def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = paths.extension(F.col("path"))
    return part_files(spark, sf_dir).select("path", ext.alias("ext"), paths.category(ext).alias("category"))


@query("p1_url_category", r"""
SELECT page_id, lower(regexp_extract(regexp_extract(url, '^([^?#]*)', 1), '[^/\\]\.([^./\\]*)$', 1)) AS ext
FROM pages""")
def p1_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_extract("url", r"^([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", paths.extension(bare).alias("ext"))


@query("p2_supported_only", f"WITH {FILES_CTE} SELECT ord, path FROM files WHERE {SQL_EXT} IN ({SQL_KNOWN}) AND {SQL_EXT} NOT IN ('gif', 'zip')")
def p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = supported_only(part_files(spark, sf_dir), "path", disabled=("gif", "zip"))
    return kept.select("ord", "path")


@query("p3_verb_gate", f"""WITH {FILES_CTE}
SELECT ord, {SQL_EXT} IN ({SQL_KNOWN}) AND {SQL_EXT} NOT IN ({_in(C.ARCHIVE_EXTS)}) AS is_image,
       {sql_category(SQL_EXT)} = 'Audio' AS is_audio FROM files""")
def p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_files(spark, sf_dir).select(
        "ord", paths.verb_gate(paths.extension(F.col("path"))).alias("g")
    ).select("ord", "g.*")


# A head per file: text, a picture signature or a binary blob.
HEAD_HEX = case_of("ord", ["", "89504E470D0A1A0A", "68656C6C6F", "6865000000", "FFD8FFE0", "504B0304"])


@query("p4_content_kind", f"""WITH {FILES_CTE}, k AS (
  SELECT ord, {SQL_EXT} AS ext, ord % 31 = 0 AS is_dir, {HEAD_HEX} AS head FROM files)
SELECT ord, CASE WHEN is_dir THEN 'InfoCard'
  WHEN ext IN ({_in(C.MARKDOWN_EXTS)}) THEN 'Markdown' WHEN ext IN ({_in(C.DOC_EXTS)}) THEN 'Markdown'
  WHEN ext IN ({_in(C.TEXT_EXTS)}) THEN 'Text'
  WHEN ext IN ({SQL_KNOWN}) AND {sql_category('ext')} IN ('Video', 'Audio') THEN 'Video'
  WHEN ext IN ({SQL_KNOWN}) THEN 'Image'
  WHEN head <> '' AND head NOT LIKE '%0000%' THEN 'Text'
  WHEN head LIKE '89504E470D0A1A0A%' OR head LIKE 'FFD8FF%' THEN 'Image' ELSE 'InfoCard' END AS kind
FROM k""")
def p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.unhex(F.expr(HEAD_HEX))
    kind = paths.content_kind(F.col("path"), F.col("ord") % 31 == 0, head)
    return part_files(spark, sf_dir).select("ord", kind.alias("kind"))


@query("p4_content_kind_text_off", f"""WITH {FILES_CTE}, k AS (
  SELECT ord, {SQL_EXT} AS ext, ord % 31 = 0 AS is_dir, {HEAD_HEX} AS head FROM files)
SELECT ord, CASE WHEN is_dir THEN 'InfoCard' WHEN ext IN ({_in(C.MARKDOWN_EXTS)}) OR ext = 'ipynb' THEN 'Markdown'
  WHEN ext IN ({SQL_KNOWN}) AND {sql_category('ext')} IN ('Video', 'Audio') THEN 'Video'
  WHEN ext IN ({SQL_KNOWN}) THEN 'Image'
  WHEN head LIKE '89504E470D0A1A0A%' OR head LIKE 'FFD8FF%' THEN 'Image' ELSE 'InfoCard' END AS kind
FROM k""")
def p4_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.unhex(F.expr(HEAD_HEX))
    kind = paths.content_kind(F.col("path"), F.col("ord") % 31 == 0, head, text=False)
    return part_files(spark, sf_dir).select("ord", kind.alias("kind"))


# Every signature in front of a document's own text.
SIGNED_HEX = case_of("doc_id", [
    "89504E470D0A1A0A", "FFD8FF", "474946383761", "474946383961", "424D", "524946460000000057454250",
    "716F6966", "000000006674797061766966", "000000006674797068656963", "000000006674797068656978",
    "00000000667479706D696631", "49492A00", "4D4D002A", "504B0304", "504B0506", "504B0708",
    "377ABCAF271C", "526172211A07", "38425053", "424C454E444552", "1F8B", "28B52FFD", "", "00", "524946460000000041564920",
])
SIGNED_KIND = case_of("doc_id", [
    "png", "jpeg", "gif", "gif", "bmp", "webp", "qoi", "avif", "heic", "heic", "heif", "tiff", "tiff",
    "zip", "zip", "zip", "7z", "rar", "psd", "blend", "gzip", "zstd", "", "", "",
])


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.unhex(F.expr(SIGNED_HEX)), F.encode("text", "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))


@query("p5_magic_kind", f"SELECT nullif({SIGNED_KIND}, '') AS kind, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS text_bytes FROM documents GROUP BY 1")
def p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = _signed(spark, sf_dir).withColumn("kind", signatures.magic_kind(F.col("content")))
    prefix = F.octet_length(F.unhex(F.expr(SIGNED_HEX)))
    return signed.groupBy("kind").agg(
        F.count("*").alias("n"), F.sum(F.octet_length("content") - prefix).alias("text_bytes")
    )


@query("p6_is_binary", """
SELECT doc_id, doc_id % 3 = 0 OR (doc_id % 3 = 2 AND strlen(text) <= 16383) AS is_binary FROM documents""")
def p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two zero bytes in front, one zero byte in front, or two behind the text."""
    body = F.encode("text", "UTF-8")
    pair, single = F.unhex(F.lit("0000")), F.unhex(F.lit("00"))
    content = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(pair, body))
        .when(F.col("doc_id") % 3 == 1, F.concat(single, body))
        .otherwise(F.concat(body, pair))
    )
    return table(spark, sf_dir, "documents").select("doc_id", signatures.is_binary(content).alias("is_binary"))


@query("p7_decode_text", f"""
SELECT doc_id, {case_of('doc_id', ['utf-8', 'utf-8-bom', 'utf-16le', 'utf-16be', 'utf-8', 'utf-16le-sniffed', 'legacy'])} AS encoding,
       CASE doc_id % 7 WHEN 5 THEN 'plain text ' || doc_id || ' ' || text
            WHEN 6 THEN 'plain text ' || doc_id || ' ' || regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') || ' café' ELSE text END AS decoded
FROM documents""")
def p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document stored in one of seven ways and read back to the same text."""
    plain = F.concat(F.lit("plain text "), F.col("doc_id").cast("string"))
    which = F.col("doc_id") % 7
    # A legacy page is told by its last letter alone; other accents side by side could be of several pages.
    ascii_text = F.regexp_replace("text", r"[^\x00-\x7F]", "")
    content = (
        F.when(which == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
        .when(which == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
        .when(which == 3, F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE")))
        .when(which == 5, F.encode(F.concat(plain, F.lit(" "), "text"), "UTF-16LE"))
        .when(which == 6, F.encode(F.concat(plain, F.lit(" "), ascii_text, F.lit(" café")), "ISO-8859-1"))
        .otherwise(F.encode("text", "UTF-8"))
    )
    stored = table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))
    return stored.select(
        "doc_id", text_encoding(F.col("content")).alias("encoding"),
        decode_text(F.col("content"), cap=None).alias("decoded"),
    )


_CJK = case_of("doc_id", ["これは日本語です", "中文内容", "한국어 텍스트", "", "ｱｲｳ", "㐀㐁"])


@query("p8_script_profile", f"""
WITH d AS (SELECT doc_id, {_CJK} || CASE WHEN doc_id % 2 = 0 THEN text ELSE reverse(text) END AS t FROM documents),
c AS (SELECT doc_id,
  len(regexp_extract_all(t, '[^\\x00-\\x7F]')) AS na, len(regexp_extract_all(t, '[\\x{{3040}}-\\x{{30FF}}]')) AS kana,
  len(regexp_extract_all(t, '[\\x{{AC00}}-\\x{{D7A3}}]')) AS hangul, len(regexp_extract_all(t, '[\\x{{4E00}}-\\x{{9FFF}}]')) AS ideo,
  len(regexp_extract_all(t, '[\\x{{3000}}-\\x{{303F}}\\x{{FF01}}-\\x{{FF60}}\\x{{FFE0}}-\\x{{FFE6}}]')) AS punct,
  len(regexp_extract_all(t, '[\\x{{E000}}-\\x{{F8FF}}\\x{{FFF0}}-\\x{{FFFF}}]')) AS special,
  len(regexp_extract_all(t, '[\\x{{3400}}-\\x{{4DBF}}\\x{{F900}}-\\x{{FAFF}}\\x{{20000}}-\\x{{3FFFF}}]')) AS rare FROM d)
SELECT doc_id, ideo, kana, hangul, punct, na AS non_ascii,
  CAST(CASE WHEN na = 0 OR (ideo + kana + hangul + punct) * 4 < na * 3 THEN 0 ELSE greatest(1,
    (ideo + kana + hangul + punct) - 3 * special - 2 * rare - (na - (ideo + kana + hangul + punct) - special - rare)
    + CASE WHEN ideo + kana + hangul > 0 AND (hangul * 20 >= (ideo + kana + hangul) * 13
        OR kana * 20 >= (ideo + kana + hangul) * 3) THEN 1000 ELSE 0 END) END AS BIGINT) AS score
FROM c""")
def p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.concat(F.expr(_CJK), F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.reverse("text")))
    profiled = table(spark, sf_dir, "documents").select("doc_id", T.script_profile(mixed).alias("p"))
    return profiled.select(
        "doc_id", "p.ideo", "p.kana", "p.hangul", "p.punct", "p.non_ascii",
        T.script_score(F.col("p")).alias("score"),
    )


@query("p9_clip_lines", r"""
WITH l AS (SELECT doc_id, text, string_split_regex(text, '\r?\n') AS p FROM documents),
k AS (SELECT doc_id, text, CASE WHEN p[-1] = '' THEN p[1:len(p)-1] ELSE p END AS p FROM l)
SELECT doc_id, md5(CASE WHEN len(list_filter(p, lambda x: length(x) > 120)) = 0 THEN text
  ELSE array_to_string(list_transform(p, lambda x: CASE WHEN length(x) > 120 THEN left(x, 120) || '…' ELSE x END), chr(10)) END) AS digest
FROM k""")
def p9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(T.clip_lines(F.col("text"), 120)).alias("digest")
    )


@query("p10_header_dims", """
SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_size * 97 AS BIGINT) END AS width,
       CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_size + 300 AS BIGINT) END AS height FROM part""")
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of four formats built from part sizes, some with a zero width."""
    width = F.when(F.col("p_partkey") % 13 == 0, 0).otherwise(F.col("p_size") * 97)
    height = F.col("p_size") + 300

    def be(value: Column) -> Column:
        return F.lpad(F.hex(value), 8, "0")

    def le(value: Column, size: int) -> Column:
        digits = F.lpad(F.hex(value), size * 2, "0")
        return F.concat(*[F.substring(digits, i, 2) for i in range(size * 2 - 1, 0, -2)])

    kind = F.col("p_partkey") % 4
    header = (
        F.when(kind == 0, F.concat(F.lit("38425053" + "00" * 10), be(height), be(width)))
        .when(kind == 1, F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), be(width), be(height)))
        .when(kind == 2, F.concat(F.lit("474946383961"), le(width, 2), le(height, 2)))
        .otherwise(F.concat(F.lit("424D" + "00" * 16), le(width, 4), le(height, 4)))
    )
    heads = table(spark, sf_dir, "part").select("p_partkey", F.unhex(header).alias("head"))
    dims = heads.select("p_partkey", signatures.header_dims(F.col("head")).alias("d"))
    return dims.select("p_partkey", "d.width", "d.height")


_XMP = (
    "'noise<x:xmpmeta ' || CASE WHEN p_partkey % 3 = 0 THEN 'Iptc4xmpExt:AiPrompt=\"' || p_name || ' &amp; ' || p_brand || '\">' "
    "ELSE '><Iptc4xmpExt:AiPrompt> ' || p_name || ' &lt;x&gt;</Iptc4xmpExt:AiPrompt>' END || "
    "CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '<mwg-rs:PersonDisplayName>' || p_type || '</mwg-rs:PersonDisplayName>"
    "<mwg-rs:PersonDisplayName>' || p_brand || '</mwg-rs:PersonDisplayName><mwg-rs:PersonDisplayName>' || p_type || '</mwg-rs:PersonDisplayName>' END || "
    "CASE WHEN p_partkey % 11 = 0 THEN '' ELSE '</x:xmpmeta>tail' END"
)


@query("p11_xmp_facts", """
SELECT p_partkey, 'AI prompt' AS label,
       CASE WHEN p_partkey % 3 = 0 THEN p_name || ' & ' || p_brand ELSE p_name || ' <x>' END AS value
FROM part WHERE p_partkey % 11 <> 0
UNION ALL
SELECT p_partkey, 'People', p_type || ', ' || p_brand FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 4 <> 0""")
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.encode(F.expr(_XMP), "UTF-8")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.explode(signatures.xmp_facts(content)).alias("f")
    ).select("p_partkey", "f.*")


@query("p12_junk_sample", f"""
WITH s AS (SELECT page_id, {case_of('page_id', ['', 'x', '404: Not Found ', 'ok <b>'])} || CASE WHEN page_id % 4 = 1 THEN replace(html, '<', ' ') ELSE html END AS body FROM pages
  UNION ALL SELECT -1 - page_id, left(html, 5 + page_id % 90) FROM pages),
h AS (SELECT page_id, strlen(body) AS n, left(body, 256) AS head FROM s)
SELECT page_id, n < 64 OR regexp_matches(head, '(?im)^\\s*<!doctype\\s+html') OR regexp_matches(head, '(?im)^\\s*<html[\\s>]')
  OR regexp_matches(head, '(?i)404:?\\s*Not Found|Access Denied|<Error>') OR regexp_matches(head, '(?i)^version https://git-lfs') AS junk
FROM h""")
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.expr(case_of("page_id", ["", "x", "404: Not Found ", "ok <b>"]))
    body = F.when(F.col("page_id") % 4 == 1, F.replace("html", F.lit("<"), F.lit(" "))).otherwise(F.col("html"))
    pages = table(spark, sf_dir, "pages")
    # Whole pages, and beside each one a short beginning of it.
    short = F.substring("html", F.lit(1), (5 + F.col("page_id") % 90).cast("int"))
    samples = pages.select("page_id", F.concat(prefix, body).alias("body")).union(
        pages.select(-1 - F.col("page_id"), short)
    )
    return samples.select("page_id", signatures.junk_sample(F.encode("body", "UTF-8")).alias("junk"))


@query("p13_valid_email", r"""
WITH v AS (SELECT c_custkey, lower(replace(c_name, '#', CASE c_custkey % 6 WHEN 0 THEN '.' WHEN 1 THEN '@' WHEN 2 THEN ' ' WHEN 3 THEN '+' WHEN 4 THEN ',' ELSE '_' END))
  || CASE c_custkey % 5 WHEN 0 THEN '@example.com' WHEN 1 THEN '@ex-ample.io' WHEN 2 THEN '@-bad.com' WHEN 3 THEN '@a..b.com' ELSE '@host.c0m' END AS value FROM customer)
SELECT c_custkey, strlen(value) BETWEEN 6 AND 120
  AND regexp_matches(value, '^[!#$%&''*+.0-9=?A-Z^_`a-z|~-]{1,64}@[A-Za-z0-9.-]+$')
  AND NOT regexp_matches(value, '@-|-$|@\.|\.\.') AND regexp_matches(value, '@.+\.[A-Za-z]{2,}$') AS ok FROM v""")
def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.expr(
        "lower(replace(c_name, '#', CASE c_custkey % 6 WHEN 0 THEN '.' WHEN 1 THEN '@' WHEN 2 THEN ' ' "
        "WHEN 3 THEN '+' WHEN 4 THEN ',' ELSE '_' END)) || CASE c_custkey % 5 WHEN 0 THEN '@example.com' "
        "WHEN 1 THEN '@ex-ample.io' WHEN 2 THEN '@-bad.com' WHEN 3 THEN '@a..b.com' ELSE '@host.c0m' END"
    )
    return table(spark, sf_dir, "customer").select("c_custkey", T.valid_email(value).alias("ok"))


# A token of every shape, long enough or one character short, around the text's own digest.
TOKEN_PREFIX = case_of("doc_id", [
    "sk_live_", "pk_test_", "sk-", "ghp_", "ghs_", "github_pat_", "xoxb-", "AKIA", "AIza", "zz_",
])
TOKEN_LENGTH = "(CASE doc_id % 10 WHEN 0 THEN 16 WHEN 1 THEN 15 WHEN 2 THEN 20 WHEN 3 THEN 36 WHEN 4 THEN 35 WHEN 5 THEN 22 WHEN 6 THEN 10 WHEN 7 THEN 16 WHEN 8 THEN 35 ELSE 30 END)"


@query("p14_secret_kind", f"""
WITH t AS (SELECT doc_id, {TOKEN_PREFIX} || left(upper(md5(text) || md5(source)), {TOKEN_LENGTH}) AS token FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(token, '^(sk|pk|rk)_(live|test)_[A-Za-z0-9]{{16,}}$') THEN 'payment_key'
  WHEN regexp_matches(token, '^sk-[A-Za-z0-9_-]{{20,}}$') THEN 'api_key'
  WHEN regexp_matches(token, '^gh[pousr]_[A-Za-z0-9]{{36,}}$') THEN 'repo_token'
  WHEN regexp_matches(token, '^github_pat_[A-Za-z0-9_]{{22,}}$') THEN 'repo_fine_token'
  WHEN regexp_matches(token, '^xox[baprs]-[A-Za-z0-9-]{{10,}}$') THEN 'chat_token'
  WHEN regexp_matches(token, '^AKIA[A-Z0-9]{{16}}$') THEN 'cloud_key_id'
  WHEN regexp_matches(token, '^AIza[A-Za-z0-9_-]{{35}}$') THEN 'maps_key' END AS kind FROM t""")
def p14(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.upper(F.concat(F.md5("text"), F.md5("source")))
    token = F.concat(F.expr(TOKEN_PREFIX), F.substring(digest, F.lit(1), F.expr(TOKEN_LENGTH)))
    return table(spark, sf_dir, "documents").select("doc_id", T.secret_kind(token).alias("kind"))


@query("p19_size_over_limit", f"""WITH {FILES_CTE}
SELECT ord, 'input is ' || length || ' bytes, over the effective limit of ' || least(20000000 + ord, 30000000) || ' bytes' AS reason
FROM files WHERE length > least(20000000 + ord, 30000000)""")
def p19(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = sizes.size_over_limit(
        F.col("length"), (F.col("ord") + 20_000_000).cast("bigint"), F.lit(30_000_000).cast("bigint")
    )
    return part_files(spark, sf_dir).select("ord", reason.alias("reason")).filter("reason IS NOT NULL")


# --- scalar functions ---------------------------------------------------------------------

@query("f1_human_size", f"SELECT doc_id, {sql_sized('(n_chars * (doc_id * doc_id * doc_id + 1))')} AS size FROM documents")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Sizes beyond 64 bits: from some 40,000 documents on the product needs a decimal.
    d, n = (F.col(c).cast("decimal(19,0)") for c in ("doc_id", "n_chars"))
    return table(spark, sf_dir, "documents").select("doc_id", sizes.human_size(n * (d * d * d + 1)).alias("size"))


SIZE_TEXT = "p_size || " + case_of("p_partkey", ["MB", "kb", "", " m", ".5k", "b", "xx", "e1", "d", ".25MB"])


@query("f2_parse_size", f"""
WITH t AS (SELECT p_partkey, {SIZE_TEXT} AS s FROM part),
n AS (SELECT p_partkey, regexp_replace(lower(trim(s)), 'b$', '') AS core FROM t),
v AS (SELECT p_partkey, CASE WHEN core LIKE '%m' THEN 1e6 WHEN core LIKE '%k' THEN 1e3 ELSE 1 END AS f, trim(regexp_replace(core, '[mk]$', '')) AS num FROM n)
SELECT p_partkey, CAST(floor(CASE WHEN regexp_matches(num, '^[0-9]+([.][0-9]*)?([eE][0-9]+)?$') THEN try_cast(num AS DOUBLE) END * f) AS BIGINT) AS bytes FROM v""")
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", sizes.parse_size(F.expr(SIZE_TEXT)).alias("bytes"))


@query("f3_fit_dims", """
WITH t AS (SELECT p_partkey, CAST(p_size * 100 AS DOUBLE) AS w, CAST(p_size * 37 + 50 AS DOUBLE) AS h FROM part)
SELECT p_partkey,
  CAST(CASE WHEN p_partkey % 3 = 0 THEN greatest(floor(w * (CAST(least(greatest(p_partkey % 1200, 1), 1000) AS DOUBLE) / 100) + 0.5), 1)
       WHEN p_partkey % 3 = 1 THEN CASE WHEN w > 800 OR h > 600 THEN greatest(floor(w * least(800 / w, 600 / h) + 0.5), 1) ELSE w END ELSE w END AS BIGINT) AS width,
  CAST(CASE WHEN p_partkey % 3 = 0 THEN greatest(floor(h * (CAST(least(greatest(p_partkey % 1200, 1), 1000) AS DOUBLE) / 100) + 0.5), 1)
       WHEN p_partkey % 3 = 1 THEN CASE WHEN w > 800 OR h > 600 THEN greatest(floor(h * least(800 / w, 600 / h) + 0.5), 1) ELSE h END ELSE h END AS BIGINT) AS height
FROM t""")
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = F.expr("CASE p_partkey % 3 WHEN 0 THEN (p_partkey % 1200) || '%' WHEN 1 THEN '800x600' ELSE 'bad' END")
    fitted = sizes.fit_dims(F.col("p_size") * 100, F.col("p_size") * 37 + 50, sizes.parse_resize(request))
    return table(spark, sf_dir, "part").select("p_partkey", fitted.alias("f")).select("p_partkey", "f.*")


VERSION_TEXT = "CASE p_partkey % 5 WHEN 0 THEN 'v' WHEN 1 THEN 'V' WHEN 2 THEN ' ' WHEN 3 THEN 'x' ELSE '' END || (p_partkey % 3) || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '.' || p_size ELSE '.' || p_size || '.' || (p_partkey % 9) END || CASE p_partkey % 7 WHEN 0 THEN '-rc1' WHEN 1 THEN '+build.5' ELSE '' END"


@query("f4_parse_version", f"""
WITH t AS (SELECT p_partkey, regexp_replace(trim({VERSION_TEXT}), '^[vV]+', '') AS s FROM part),
c AS (SELECT p_partkey, string_split(regexp_extract(s, '^([^+-]*)', 1), '.') AS p FROM t),
v AS (SELECT p_partkey, try_cast(p[1] AS BIGINT) AS major, coalesce(try_cast(p[2] AS BIGINT), 0) AS minor, coalesce(try_cast(p[3] AS BIGINT), 0) AS patch FROM c)
SELECT p_partkey, major, CASE WHEN major IS NOT NULL THEN minor END AS minor, CASE WHEN major IS NOT NULL THEN patch END AS patch,
  CASE WHEN major IS NULL THEN false ELSE (major, minor, patch) > (1, 25, 3) END AS newer FROM v""")
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(VERSION_TEXT)
    parsed = table(spark, sf_dir, "part").select(
        "p_partkey", sizes.parse_version(text).alias("v"), sizes.is_newer(text, F.lit("v1.25.3")).alias("newer")
    )
    return parsed.select("p_partkey", "v.*", "newer")


STAMP = "CASE o_orderkey % 6 WHEN 0 THEN '0000:00:00 00:00:00' WHEN 1 THEN 'never' ELSE replace(substring(CAST(o_orderdate AS VARCHAR(19)), 1, 10), '-', ':') || ' 12:' || lpad(CAST(o_orderkey % 60 AS VARCHAR(4)), 2, '0') || ':07' END"


@query("f5_exif_time", f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 6 <= 1 THEN NULL ELSE
  substring(CAST(o_orderdate AS VARCHAR), 1, 10) || ' 12.' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || '.07' END AS taken FROM orders""")
def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", media.exif_time(F.expr(STAMP)).alias("taken"))


@query("f6_local_to_utc", """
SELECT event_id, strftime(date_trunc('second', ts) - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS taken_utc FROM events""")
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.substring(F.col("ts").cast("string"), 1, 19)
    utc = media.local_to_utc(F.replace(written, F.lit("-"), F.lit(":")), "Asia/Tokyo")
    return table(spark, sf_dir, "events").select(
        "event_id", F.substring(utc.cast("string"), 1, 19).alias("taken_utc")
    )


@query("f7_gps_decimal", """
SELECT event_id, round(CASE WHEN event_id % 4 IN (1, 3) THEN -1 ELSE 1 END
  * (CAST(event_id % 90 AS DOUBLE) + CAST(user_id % 60 AS DOUBLE) / 60 + value / 3600), 9) AS degrees FROM events""")
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.expr("CASE event_id % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'S' WHEN 2 THEN 'E' ELSE 'W' END")
    degrees = media.gps_decimal(
        (F.col("event_id") % 90).cast("double"), (F.col("user_id") % 60).cast("double"), F.col("value"), ref
    )
    return table(spark, sf_dir, "events").select("event_id", F.round(degrees, 9).alias("degrees"))


@query("f8_unit_normalise", """
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) * 2.54 ELSE CAST(p_size AS DOUBLE) END AS dpi,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) * 10000 END AS ticks,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) * 1000 END AS bps FROM part""")
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.when(F.col("p_partkey") % 4 == 0, 0).otherwise(F.col("p_size"))
    unit = F.when(F.col("p_partkey") % 3 == 0, 3).otherwise(2)
    return table(spark, sf_dir, "part").select(
        "p_partkey", media.to_dpi(amount.cast("double"), unit).alias("dpi"),
        media.to_ticks(amount).alias("ticks"), media.to_bits_per_second(amount).alias("bps"),
    )


@query("f9_safe_component", r"""
WITH n AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN ' ..' || substring(url, 1, 4) || '. . ' WHEN 2 THEN ' . ' WHEN 3 THEN 'Con.' || page_id ELSE regexp_replace(url, '[^a-z]', '', 'g') || '. ' END AS s FROM pages),
c AS (SELECT page_id, trim(regexp_replace(trim(regexp_replace(s, '[<>:"/\\|?*\x00-\x1F]', '-', 'g')), '[. ]+$', '')) AS s FROM n)
SELECT page_id, CASE WHEN s = '' OR upper(regexp_extract(s, '^([^.]*)', 1)) IN ('CON', 'PRN', 'AUX', 'NUL') THEN 'image' ELSE s END AS name FROM c""")
def f9(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr(
        "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN ' ..' || substring(url, 1, 4) || '. . ' WHEN 2 THEN ' . ' "
        "WHEN 3 THEN 'Con.' || page_id ELSE regexp_replace(url, '[^a-z]', '') || '. ' END"
    )
    return table(spark, sf_dir, "pages").select("page_id", T.safe_component(name).alias("name"))


@query("f10_expand_template", r"""
SELECT c_custkey, regexp_replace(CASE WHEN c_custkey % 7 = 0 THEN 'Unknown' ELSE n_name END, '[:/]', '-', 'g') || '/' ||
  CASE WHEN c_custkey % 5 = 0 THEN '$title' ELSE c_mktsegment END || '/' ||
  CASE WHEN c_custkey % 3 = 0 THEN 'Unknown' ELSE printf('%02d', c_custkey % 150) END || ' - ' || replace(c_name, '#', ' ') AS folder
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    key = F.col("c_custkey")
    expanded = T.expand_template(
        r"$artist\$album/ $track - $title ",
        artist=F.when(key % 7 != 0, F.col("n_name")),
        album=F.when(key % 5 == 0, "$title").otherwise(F.col("c_mktsegment")),
        title=F.replace("c_name", F.lit("#"), F.lit(" ")),
        track=F.when(key % 3 != 0, (key % 150).cast("int")),
        missing="Unknown",
    )
    return tags.select("c_custkey", T.template_path(expanded).alias("folder"))


@query("f11_rename_base", r"""
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 <= 1 THEN NULL ELSE
    substring(CAST(o_orderdate AS VARCHAR), 1, 10) || ' 12.' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || '.07' END AS taken,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS camera,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE c_name END AS title,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS artist,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 150 END AS track
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, taken AS date_taken, CASE WHEN camera IS NULL THEN taken ELSE camera || ' ' || taken END AS camera_date,
  CASE WHEN artist IS NULL THEN title ELSE artist || ' - ' || title END AS artist_title,
  CASE WHEN track IS NULL THEN title ELSE printf('%02d', track) || ' - ' || title END AS track_title FROM t""")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    key = F.col("o_orderkey")
    tags = {
        "taken": media.exif_time(F.expr(STAMP)),
        "camera": F.when(key % 4 != 0, F.col("o_orderpriority")),
        "title": F.when(key % 5 != 0, F.col("c_name")),
        "artist": F.when(key % 3 != 0, F.col("c_mktsegment")),
        "track": F.when(key % 7 != 0, (key % 150).cast("int")),
    }
    patterns = ("date_taken", "camera_date", "artist_title", "track_title")
    return joined.select("o_orderkey", *[T.rename_base(p, **tags).alias(p) for p in patterns])


@query("f12_dimension_folder", """
SELECT folder, count(*) FILTER (WHERE folder IS NOT NULL) AS moved, count(*) FILTER (WHERE folder IS NULL) AS skipped
FROM (SELECT CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size || 'x' || (p_size * 2) END AS folder FROM part) GROUP BY folder""")
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = F.when(F.col("p_partkey") % 9 != 0, F.col("p_size"))
    folders = table(spark, sf_dir, "part").select(sizes.dimension_folder(width, F.col("p_size") * 2).alias("folder"))
    return folders.groupBy("folder").agg(
        F.count("folder").alias("moved"), F.count_if(F.col("folder").isNull()).alias("skipped")
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("f13_fold_ascii", f"SELECT doc_id, md5(translate(text, '{_UPPER}', '{_LOWER}')) AS digest, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = T.fold_ascii(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(folded).alias("digest"), F.octet_length(folded).cast("bigint").alias("bytes")
    )


def sql_hits(source: str, keys: str, needle: str) -> str:
    """Rows (keys, rank, n, off): byte offsets of the hits of an ASCII-folded needle."""
    folded = needle.translate(str.maketrans(_UPPER, _LOWER))
    width = len(folded.encode())
    return (
        f"(SELECT {keys}, rank, n, CAST(sum(strlen(p) + {width}) OVER (PARTITION BY {keys} ORDER BY rank) - {width} AS BIGINT) AS off "
        f"FROM (SELECT {keys}, unnest(parts) AS p, generate_subscripts(parts, 1) AS rank, len(parts) - 1 AS n "
        f"FROM (SELECT {keys}, string_split(translate(text, '{_UPPER}', '{_LOWER}'), '{folded}') AS parts FROM {source})) WHERE rank <= n)"
    )


@query("f14_find_all", f"""
SELECT d.doc_id, coalesce(h.offsets, '') AS offsets FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(CAST(off AS VARCHAR), ',' ORDER BY rank) AS offsets FROM {sql_hits('documents', 'doc_id', 'The')} GROUP BY doc_id) h
ON d.doc_id = h.doc_id""")
def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = T.find_all(F.col("text"), F.lit("The"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(F.transform(hits, lambda h: h.cast("string")), ",").alias("offsets")
    )


LINK_TEXT = (
    "'Read ' || url || ', (' || url || ') or www.site' || page_id || '.org/a_(b' || page_id || '). no' || url "
    "|| ' http://localhost/' || page_id || ' \"' || upper(url) || '!\" www.x' || page_id || '.net/(a)b)). https:// <' || url || '> É' || url || 'é.com'"
)


@query("f15_linkify", rf"""
WITH t AS (SELECT page_id, {LINK_TEXT} AS t FROM pages),
r AS (SELECT page_id, unnest(regexp_extract_all(t, '(?:^|[ \t\n\r(\[{{<*_~"''])((?:(?i:https?://|www\.))[A-Za-z0-9._~:/?#\[\]@!$&''()*+,;=%-]+)', 1)) AS raw FROM t),
p AS (SELECT page_id, raw, regexp_extract(raw, '([.,;:!?''"*_~)]*)$', 1) AS tail FROM r),
b AS (SELECT page_id, tail, left(raw, length(raw) - length(tail)) AS body FROM p),
k AS (SELECT page_id, body, tail, greatest(least(length(tail) - length(replace(tail, ')', '')),
   (length(body) - length(replace(body, '(', ''))) - (length(body) - length(replace(body, ')', '')))), 0) AS keep FROM b),
u AS (SELECT page_id, body || CASE WHEN keep > 0 THEN array_to_string(string_split(tail, ')')[1:keep], ')') || ')' ELSE '' END AS u FROM k)
SELECT page_id, u AS text, CASE WHEN lower(u) LIKE 'www%' THEN 'https://' || u ELSE u END AS href, count(*) AS n FROM u
WHERE contains(regexp_replace(u, '^(?i:https?://|www\.)', ''), '.') GROUP BY ALL""")
def f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select(
        "page_id", F.explode(T.linkify(F.expr(LINK_TEXT))).alias("l")
    )
    return found.groupBy("page_id", "l.text", "l.href").agg(F.count("*").alias("n"))


ESCAPED = "replace(replace(url, '/', '%2F'), '=', CASE page_id % 3 WHEN 0 THEN '%zz' WHEN 1 THEN '+%C3%A9' ELSE '%3d%4~' END)"


@query("f16_percent_decode", "SELECT page_id, replace(url, '=', CASE page_id % 3 WHEN 0 THEN '%zz' WHEN 1 THEN '+é' ELSE '=%4~' END) AS decoded FROM pages")
def f16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.percent_decode(F.expr(ESCAPED)).alias("decoded"))


SRC = "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN './img/' || page_id || '.png?x=1' WHEN 2 THEN 'pics%20of/' || page_id || '.gif#f' WHEN 3 THEN '#top' ELSE '/abs/' || page_id || '.jpg' END"


@query("f17_resolve_src", f"""
SELECT page_id, page_id % 5 = 0 AS remote, CASE page_id % 5 WHEN 1 THEN 'docs/img/' || page_id || '.png' WHEN 2 THEN 'docs/pics of/' || page_id || '.gif'
  WHEN 4 THEN '/abs/' || page_id || '.jpg' END AS local FROM pages""")
def f17(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = F.expr(SRC)
    remote = T.is_remote(src)
    return table(spark, sf_dir, "pages").select(
        "page_id", remote.alias("remote"), F.when(~remote, T.resolve_src(src, F.lit("docs"))).alias("local")
    )


ENTITY_TEXT = "html || ' &#65; &#x2014; &bogus; &amp;lt; &nbsp;| &' || page_id || '; &hellip;&rarr;'"


@query("f18_decode_entities", f"""
SELECT page_id, md5(array_to_string(list_transform(regexp_extract_all({ENTITY_TEXT}, '(&(?:#[0-9]{{1,9}}|#[xX][0-9A-Fa-f]{{1,8}}|[a-z]+);|[^&]+|&)'),
  lambda t: CASE t WHEN '&amp;' THEN '&' WHEN '&copy;' THEN '©' WHEN '&middot;' THEN '·' WHEN '&quot;' THEN '"' WHEN '&#65;' THEN 'A'
    WHEN '&#x2014;' THEN '—' WHEN '&nbsp;' THEN chr(160) WHEN '&hellip;' THEN '…' WHEN '&rarr;' THEN '→' ELSE t END), '')) AS digest FROM pages""")
def f18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", F.md5(T.decode_entities(F.expr(ENTITY_TEXT))).alias("digest")
    )


@query("f19_collapse_ws", r"SELECT page_id, md5(regexp_replace(replace(html, '>', '> ' || chr(10) || chr(9) || ' ' || chr(160)), '[ \t\r\n]+', ' ', 'g')) AS digest FROM pages")
def f19(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.replace("html", F.lit(">"), F.lit("> \n\t  "))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.collapse_ws(spaced)).alias("digest"))


@query("f20_md_escape", r"""
SELECT page_id, md5(regexp_replace(regexp_replace(html || chr(10) || '[x](y) `*_~|' || chr(92), '([\\|\[\]`*_!<~])', '\\\1', 'g'), '[\r\n]', ' ', 'g')) AS digest FROM pages""")
def f20(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.concat("html", F.lit("\n[x](y) `*_~|\\"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.md_escape(cell)).alias("digest"))


@query("f21_strip_ansi", "SELECT doc_id, md5(replace(text, ' ', '')) AS digest FROM documents")
def f21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every space of a text replaced by a colour sequence, then stripped again."""
    coloured = F.concat(F.replace("text", F.lit(" "), F.lit("\u001b[0;31m")), F.lit("\u001b"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.strip_ansi(coloured)).alias("digest"))


@query("f22_fence_width", """
SELECT doc_id, CAST(greatest(greatest(doc_id % 7, CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 0 END), 2) + 1 AS BIGINT) AS width FROM documents""")
def f22(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(
        "text", F.repeat(F.lit("`"), (F.col("doc_id") % 7).cast("int")), F.lit("x"),
        F.when(F.col("doc_id") % 2 == 0, "````").otherwise(""),
    )
    return table(spark, sf_dir, "documents").select("doc_id", T.fence_width(body).cast("bigint").alias("width"))


CODE_NAME = "'src/' || " + case_of("doc_id", ["main.rs", "Makefile", "run", "tool", ".gitignore", "App.TSX", "notes.txt", "x.CPP", "go.mod"])
SHEBANG = case_of("doc_id", ["", "#!/bin/sh", "#!/usr/bin/env python3 -u", "#! /usr/local/bin/node", "#!/bin/bash"])


@query("f23_code_language", f"""
WITH t AS (SELECT doc_id, doc_id % 9 AS k, doc_id % 5 AS s FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN 'rust' WHEN 1 THEN 'sh' WHEN 4 THEN 'toml' WHEN 5 THEN 'js' WHEN 7 THEN 'c' WHEN 8 THEN 'go'
  ELSE CASE s WHEN 1 THEN 'sh' WHEN 2 THEN 'py' WHEN 3 THEN 'js' WHEN 4 THEN 'sh' ELSE 'plain' END END AS lang FROM t""")
def f23(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.expr(SHEBANG), F.lit("\n"), F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", paths.code_language(F.expr(CODE_NAME), body).alias("lang")
    )


@query("j10_snap_to_bucket", """
SELECT p_partkey, CASE WHEN r <= 0 THEN NULL WHEN r <= 16 THEN 16 WHEN r <= 32 THEN 32 WHEN r <= 48 THEN 48 WHEN r <= 96 THEN 96
  WHEN r <= 256 THEN 256 WHEN r <= 768 THEN 768 WHEN r <= 1280 THEN 1280 WHEN r <= 1920 THEN 1920 ELSE 2560 END AS bucket
FROM (SELECT p_partkey, (p_size - 3) * (p_partkey % 90) AS r FROM part)""")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = (F.col("p_size") - 3) * (F.col("p_partkey") % 90)
    return table(spark, sf_dir, "part").select("p_partkey", sizes.snap_to_bucket(request).alias("bucket"))


@query("j10_normalize_sizes", """
WITH r AS (SELECT p_partkey, unnest([p_size * 20 - 100, p_size, p_size * 90]) AS s FROM part),
b AS (SELECT p_partkey, CASE WHEN s <= 16 THEN 16 WHEN s <= 32 THEN 32 WHEN s <= 48 THEN 48 WHEN s <= 96 THEN 96
  WHEN s <= 256 THEN 256 WHEN s <= 768 THEN 768 WHEN s <= 1280 THEN 1280 WHEN s <= 1920 THEN 1920 ELSE 2560 END AS b FROM r WHERE s > 0)
SELECT p_partkey, string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) AS sizes FROM (SELECT DISTINCT * FROM b) GROUP BY p_partkey""")
def j10_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    kept = sizes.normalize_sizes(F.array(size * 20 - 100, size, size * 90))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(F.transform(kept, lambda b: b.cast("string")), ",").alias("sizes")
    )


@query("l4_largest_first", """
SELECT p_partkey, string_agg(CAST(b AS VARCHAR), ',' ORDER BY b DESC) AS sizes
FROM (SELECT DISTINCT p_partkey, unnest([16, 256, CASE WHEN p_size > 25 THEN 768 ELSE 96 END]) AS b FROM part) GROUP BY p_partkey""")
def l4(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(F.lit(10), F.lit(100) * F.when(F.col("p_size") > 25, 7).otherwise(F.lit(0.9)).cast("double"), F.lit(200))
    ordered = sizes.build_order(sizes.normalize_sizes(wanted))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(F.transform(ordered, lambda b: b.cast("string")), ",").alias("sizes")
    )
