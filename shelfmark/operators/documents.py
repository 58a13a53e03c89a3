"""Document jobs that return several rows per document."""

from __future__ import annotations

from collections.abc import Collection, Iterator, Mapping, Sequence
from functools import lru_cache, reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from .. import constants as C
from ..functions import html as H
from ..functions import markdown as M
from ..functions.arrays import let
from ..functions.media import gps_decimal, to_bits_per_second, to_dpi, to_ticks
from ..functions.paths import category, extension, file_name, folder
from ..functions.sizes import dimension_folder
from ..functions.text import (
    expand_template, find_folded, fold_ascii, linkify, secret_kind, template_path, valid_email,
)
from ..scratch import pin
from .ordering import natural_key, ordered_prefix

# Bytes per block when hits are matched to pages.
PAGE_BLOCK = 1 << 16

# Page numbers that are summed together first.
PAGE_RUN = 4096


def page_texts(pages: DataFrame, key: str, html: str) -> DataFrame:
    return pages.select(key, H.html_text(F.col(html)).alias("text"))


def html_elements(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Headings, links, images and table cells as (key, kind, ord, level, target, text, width)."""
    page = F.col("_visible")
    nil = F.lit(None).cast("string")

    def rows(kind: str, items: Column, level: Column, target, text, width) -> Column:
        return F.transform(
            items,
            lambda e, i: F.struct(
                F.lit(kind).alias("kind"), i.cast("int").alias("ord"), level(e).cast("int").alias("level"),
                target(e).alias("target"), text(e).alias("text"), width(e).alias("width"),
            ),
        )

    none = lambda e: nil
    elements = F.concat(
        rows("heading", H.headings(page), lambda e: e["level"], none, lambda e: e["text"], none),
        rows("link", H.links(page), none, lambda e: e["href"], lambda e: e["text"], none),
        rows("image", H.images(page), none, lambda e: e["src"], lambda e: e["alt"], lambda e: e["width"]),
        rows("cell", H.table_cells(page), lambda e: e["row"], none, lambda e: e["text"], none),
    )
    visible = pages.select(key, H.drop_invisible(F.col(html)).alias("_visible"))
    return visible.select(key, F.explode(elements).alias("_e")).select(key, "_e.*")


def md_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Markdown blocks with their position: one pass over each text, no shuffle."""
    return docs.select(key, F.posexplode(M.md_blocks(F.col(text))).alias("ord", "_b")).select(
        key, "ord", "_b.*"
    )


def outline(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Heading outline of HTML pages, with the page's two toolbar flags."""
    page = F.col(html)
    return pages.select(
        key, H.has_headings(page).alias("has_headings"),
        H.has_remote_images(page).alias("has_remote_images"),
        F.posexplode_outer(H.headings(H.drop_invisible(page))).alias("ord", "_h"),
    ).select(key, "has_headings", "has_remote_images", "ord", "_h.level", "_h.text")


def md_outline(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = md_rows(docs, key, text)
    return rows.filter(F.col("kind") == "heading").select(key, "ord", "level", "text")


def doc_links(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.posexplode(linkify(F.col(text))).alias("ord", "_l")).select(
        key, "ord", "_l.text", "_l.href"
    )


# --- search -------------------------------------------------------------------------------

def _terms(terms: Sequence[str]) -> Column:
    return F.array(*[F.lit(t) for t in terms])


# Characters of the piece by which a term of a table is looked up.
TERM_GRAM = 5


def _grams(text: Column, length: int) -> Column:
    """Every run of so many characters of a text, overlapping."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1))


# Bytes of a piece that texts are first looked at for, and a prime near 2^22: slots of the table of such bytes.
CODE_BYTES = 5
CODE_SLOTS = 4_194_301

# Bytes of text that a task holds at a time, rows that it hands on at a time, and bytes of a needle compared one by one.
SEARCH_SLICE = 1 << 20
FOUND_ROWS = 20_000
COMPARED = 32


def term_index(terms: DataFrame, term: str, gram: int = TERM_GRAM) -> DataFrame:
    """(term, gram, code): each distinct term with the piece of it that is looked up first.

    A term of ``gram`` characters or fewer is its own piece.  Of a longer one it is the piece of
    least hash, so terms that begin alike do not meet in one piece.  The code is the piece's first
    bytes, five at most, behind a one as a number.  Empty and null terms go.
    """
    kept = terms.select(F.col(term).cast("string").alias("term")).filter("term <> ''").distinct()
    folded = fold_ascii(F.col("term"))
    pieces = F.transform(_grams(folded, gram), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g")))
    kept = kept.select("term", F.when(F.length(folded) > gram, F.array_min(pieces)["g"]).otherwise(folded).alias("gram"))
    head = F.hex(F.substring(F.encode("gram", "UTF-8"), 1, CODE_BYTES))
    return kept.withColumn("code", F.conv(F.concat(F.lit("1"), head), 16, 10).cast("bigint"))


def term_candidates(docs: DataFrame, key: str, text: str, terms: DataFrame, term: str, gram: int = TERM_GRAM) -> DataFrame:
    """(key, terms): for each document the terms whose piece it may hold, all that occur in it among them.

    The numbers of all runs of bytes in a text are computed at once for each length in use, however
    many terms there are.  A table of bits tells in the row which are worth a row; those are joined
    to the index.
    """
    index = term_index(terms, term, gram).select("term", "code")
    # One row for each 64 bits at most.
    slot = F.pmod("code", F.lit(CODE_SLOTS))
    words = index.select((slot / 64).cast("int").alias("w"), (slot % 64).cast("int").alias("b")).groupBy("w")
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits")).collect()
    packed = np.zeros(CODE_SLOTS // 64 + 1, dtype="<i8")
    packed[[r.w for r in words]] = [r.bits for r in words]
    codes = index.select(F.floor((F.length(F.conv("code", 10, 16)) - 1) / 2).cast("int").alias("n"))
    lengths = sorted(r.n for r in codes.distinct().collect())

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.unpackbits(packed.view(np.uint8), bitorder="little").view(bool)
        for batch, texts in _text_slices(batches):
            owners, found = _met(texts, lengths, marked)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners)), pa.array(found)], names=["_key", "code"])

    kind = docs.select(F.col(key).alias("_key"), F.lit(0).cast("bigint").alias("code")).schema
    found = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).mapInArrow(known, kind)
    return found.join(index, "code").groupBy("_key").agg(F.collect_set("term").alias("_terms"))


def _text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Rows some ``SEARCH_SLICE`` bytes at a time, and their second column's texts as folded bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // SEARCH_SLICE
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            rows = batch.slice(a, b - a)
            # Of bytes, lower() changes A-Z only.
            yield rows, [t if t is None else t.lower() for t in rows.column(1).cast(pa.binary()).to_pylist()]


def _codes(data: np.ndarray, lengths: Collection[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each of the lengths the codes of all runs of so many bytes."""
    code = np.ones(len(data), dtype=np.int64)
    for length in range(1, max(lengths, default=0) + 1):
        code = (code[: len(data) - length + 1] << 8) | data[length - 1 :]
        if length in lengths:
            yield length, code


def _joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each ends."""
    data = np.frombuffer(b"".join(t or b"" for t in texts), dtype=np.uint8)
    return data, np.cumsum([len(t or b"") for t in texts], dtype=np.int64)


def _met(texts: list[bytes | None], lengths: Collection[int], marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and code, each pair once, of all runs of bytes that stand in the table."""
    data, ends = _joined(texts)
    pairs = [np.empty(0, dtype=np.int64)]
    for length, code in _codes(data, lengths):
        at = np.flatnonzero(marked[code - code // CODE_SLOTS * CODE_SLOTS])
        row = np.searchsorted(ends, at, side="right")
        inside = at + length <= ends[row]
        pairs.append((row[inside] << (8 * CODE_BYTES + 1)) | code[at[inside]])
    met = np.unique(np.concatenate(pairs))
    return met >> (8 * CODE_BYTES + 1), met & ((1 << (8 * CODE_BYTES + 1)) - 1)


@lru_cache(maxsize=1 << 16)
def _piece(needle: bytes) -> tuple[int, int]:
    """The run of bytes by which a needle is found: where it begins in the needle, and its code."""
    width = min(len(needle), CODE_BYTES)
    codes = [(int.from_bytes(b"\1" + needle[k : k + width]), k) for k in range(len(needle) - width + 1)]
    code, at = min(codes, key=lambda c: c[0] * 0x9E3779B97F4A7C15 % (1 << 64))
    return at, code


def _occurrences(texts: list[bytes | None], needles: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, needle and offset, in this order, of the non-overlapping hits of all needles in all texts."""
    data, ends = _joined(texts)
    starts = np.concatenate([[0], ends[:-1]])
    sizes = np.array([len(n) for n in needles], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = np.frombuffer(b"".join(needles), dtype=np.uint8)
    shift, codes = (np.array(c, dtype=np.int64) for c in zip(*map(_piece, needles)))
    order = np.argsort(codes, kind="stable")
    marked = np.zeros(CODE_SLOTS, dtype=bool)
    marked[codes % CODE_SLOTS] = True
    hits = []
    for _, code in _codes(data, set(np.minimum(sizes, CODE_BYTES).tolist())):
        at = np.flatnonzero(marked[code - code // CODE_SLOTS * CODE_SLOTS])
        low, high = (np.searchsorted(codes[order], code[at], side=s) for s in ("left", "right"))
        many = high - low
        needle = order[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())]
        row = np.repeat(np.searchsorted(ends, at, side="right"), many)
        at = np.repeat(at, many) - shift[needle]
        fits = (at >= starts[row]) & (at + sizes[needle] <= ends[row])
        row, needle, at = row[fits], needle[fits], at[fits]
        # Byte by byte, which few survive; what long needles have beyond is compared at once.
        for k in range(min(int(sizes.max()), COMPARED)):
            going = np.flatnonzero(sizes[needle] > k)
            wrong = going[data[at[going] + k] != flat[first[needle[going]] + k]]
            row, needle, at = (np.delete(c, wrong) for c in (row, needle, at))
        wrong = [
            i for i in np.flatnonzero(sizes[needle] > COMPARED)
            if data[at[i] : at[i] + sizes[needle[i]]].tobytes() != needles[needle[i]]
        ]
        hits.append([np.delete(c, wrong) for c in (row, needle, at - starts[row])])
    row, needle, at = (np.concatenate(c) for c in zip(*hits))
    sort = np.lexsort((at, needle, row))
    row, needle, at = row[sort], needle[sort], at[sort]
    # Where a needle meets itself, the leftmost hit stands and those that it covers go.
    close = np.flatnonzero((row[1:] == row[:-1]) & (needle[1:] == needle[:-1]) & (at[1:] < at[:-1] + sizes[needle[1:]])) + 1
    covered, stands = [], -1
    for i in close.tolist():
        if stands != i - 1 and not (covered and covered[-1] == i - 1):
            stands = i - 1
        if at[i] < at[stands] + sizes[needle[i]]:
            covered.append(i)
        else:
            stands = i
    return np.delete(row, covered), np.delete(needle, covered), np.delete(at, covered)


def _find_terms(met: DataFrame, key: str) -> DataFrame:
    """(key, term, hits) of rows (key, text, terms): the terms of a few rows at a time that a row's text holds."""
    schema = met.select(key, F.lit("").alias("term"), F.array().cast("array<bigint>").alias("hits")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _text_slices(batches):
            terms = pc.unique(pc.list_flatten(batch.column(2)))
            if not len(terms):
                continue
            row, needle, at = _occurrences(texts, [t.encode().lower() for t in terms.to_pylist()])
            edges = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (needle[1:] != needle[:-1]), [True]]))[: None if len(row) else 1]
            for a in range(0, len(edges) - 1, FOUND_ROWS):
                cut = edges[a : a + FOUND_ROWS + 1]
                lists = pa.ListArray.from_arrays(pa.array(cut - cut[0], pa.int32()), pa.array(at[cut[0] : cut[-1]]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row[cut[:-1]])), terms.take(pa.array(needle[cut[:-1]])), lists], names=[key, "term", "hits"]
                )

    return met.mapInArrow(run, schema)


def doc_hits(docs: DataFrame, key: str, text: str, terms: Sequence[str] | DataFrame, term: str = "term") -> DataFrame:
    """(key, term, hits): byte offsets per document and term.

    A few terms travel in the plan, and a text is folded once before it is looked at for each.
    Any number of them come as a table: then only the candidates of a document are looked for in it.
    """
    if isinstance(terms, DataFrame):
        candidates = term_candidates(docs, key, text, terms, term)
        met = docs.select(key, F.col(text).cast("string").alias("_text")).join(candidates, F.col(key).eqNullSafe(F.col("_key")))
        return _find_terms(met.select(key, "_text", "_terms"), key)
    folded = fold_ascii(F.col(text)).alias("_text")
    met = docs.select(key, folded).withColumn("_terms", _terms(sorted({t for t in terms if t})))
    hit = F.filter("_terms", lambda t: F.contains("_text", fold_ascii(t)))
    found = F.transform(
        hit, lambda t: F.struct(t.alias("term"), find_folded(F.col("_text"), fold_ascii(t)).alias("hits"))
    )
    return met.select(key, F.explode(found).alias("_f")).select(key, "_f.*")


def doc_search(docs: DataFrame, key: str, text: str, terms: Sequence[str] | DataFrame, term: str = "term") -> DataFrame:
    """One row per hit: rank, the "3/17" label, and the hits before and after it, wrapping.

    ``terms`` are a few strings or a column ``term`` of a table.
    """
    def around(hits: Column) -> Column:
        n = F.size(hits)
        after = F.concat(F.slice(hits, F.lit(2), n), F.slice(hits, 1, 1))
        before = F.concat(F.slice(hits, n, F.lit(1)), F.slice(hits, F.lit(1), n - 1))
        return F.transform(
            F.arrays_zip(hits.alias("o"), after.alias("a"), before.alias("b")),
            lambda z, i: F.struct(
                (i + 1).alias("rank"), n.alias("n_hits"), z["o"].alias("offset"),
                F.concat((i + 1).cast("string"), F.lit("/"), n.cast("string")).alias("label"),
                z["a"].alias("next_offset"), z["b"].alias("previous_offset"),
            ),
        )

    found = doc_hits(docs, key, text, terms, term)
    return found.select(key, "term", F.explode(let(F.col("hits"), around)).alias("_h")).select(
        key, "term", "_h.*"
    )


def resume_hit(hits: Column, start: Column) -> Column:
    """1-based position of the first hit at or after ``start``, else the first hit; NULL for none."""
    def position(h: Column) -> Column:
        before = F.size(F.filter(h, lambda offset: offset < start))
        return F.when(F.size(h) > 0, F.when(before < F.size(h), before + 1).otherwise(1))

    return let(hits, position)


def page_starts(
    pages: DataFrame, doc: str, page: str, text: str
) -> DataFrame:
    """Byte range [start, next_start) of every page; each page ends with one separator byte.

    A page without text still takes a position.
    """
    width = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1
    sized = pages.select(doc, page, width.alias("_w"))
    if not isinstance(pages.schema[page].dataType, IntegralType):
        placed = ordered_prefix(sized, [doc], [F.col(page)], number="_n", sums={"next_start": F.col("_w")})
        return placed.select(doc, page, (F.col("next_start") - F.col("_w")).alias("start"), "next_start")
    # Numbered pages are summed by runs of numbers first: a document of any length is many small groups,
    # and nothing has to be stored between the two passes.
    run = [doc, "_run"]
    sized = sized.withColumn("_run", F.floor(F.col(page) / PAGE_RUN))
    ahead = Window.partitionBy(doc).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = sized.groupBy(*run).agg(F.sum("_w").alias("_sum")).select(
        F.col(doc).alias("_doc"), F.col("_run").alias("_own"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead")
    )
    within = Window.partitionBy(*run).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("_upto", F.sum("_w").over(within)).join(
        runs, F.col(doc).eqNullSafe(F.col("_doc")) & F.col("_run").eqNullSafe(F.col("_own"))
    )
    end = F.col("_ahead") + F.col("_upto")
    return placed.select(doc, page, (end - F.col("_w")).alias("start"), end.alias("next_start"))


def hit_to_page(hits: DataFrame, starts: DataFrame, doc: str, page: str) -> DataFrame:
    """Page that holds each byte offset: an equi-join on fixed-size blocks, then the exact range.

    Keying by (document, block) keeps a document that owns a third of the hits off one task.
    """
    block = lambda c: (c / PAGE_BLOCK).cast("bigint")
    ranges = starts.withColumn(
        "_block", F.explode(F.sequence(block(F.col("start")), block(F.col("next_start") - 1)))
    )
    return (
        hits.withColumn("_block", block(F.col("offset")))
        .join(ranges, [doc, "_block"])
        .filter((F.col("start") <= F.col("offset")) & (F.col("offset") < F.col("next_start")))
        .select(*hits.columns, page, (F.col("offset") - F.col("start")).alias("page_offset"))
    )


def keyword_search(
    entries: DataFrame, terms: Sequence[str], *, ord_: str, columns: Sequence[str], first: int = 12
) -> DataFrame:
    """First entries in index order that hold a term in any of the columns.

    Terms are trimmed and lower-cased; one under two bytes returns nothing.
    """
    kept = sorted({t.strip().lower() for t in terms if len(t.strip().encode()) >= 2})
    if not kept:
        return entries.limit(0).select(F.lit("").alias("term"), F.lit(0).alias("position"), *entries.columns)
    def hit(term: Column) -> Column:
        return reduce(or_, [F.coalesce(F.contains(F.lower(F.col(c)), term), F.lit(False)) for c in columns])

    order = Window.partitionBy("term").orderBy(ord_)
    return (
        entries.withColumn("term", F.explode(F.filter(_terms(kept), hit)))
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= first)
        .select("term", "position", *entries.columns)
    )


def contacts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Whitespace-separated tokens that are valid addresses, with their position.

    Punctuation that closes a sentence or a bracket is not part of the address.
    """
    words = F.transform(
        F.split(text, r"\s+"), lambda t, i: F.struct(i.cast("int").alias("pos"), t.alias("word"))
    )
    marked = F.filter(words, lambda w: F.contains(w["word"], F.lit("@")))
    value = F.regexp_replace("_w.word", r"""^[("'<\[]+|[)"'>\],;:.!?]+$""", "")
    return (
        docs.select(key, F.explode(marked).alias("_w"))
        .select(key, "_w.pos", value.alias("value"))
        .filter(valid_email(F.col("value")))
    )


# Where a credential token can begin; the exact shape is judged afterwards.
_SECRET_START = (
    r"(?<![A-Za-z0-9_.\-])((?:sk[_-]|[pr]k_|gh[pousr]_|github_pat_|xox[baprs]-|AKIA|AIza|ey)"
    r"(?:(?<=ey)[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+|[A-Za-z0-9_\-]{6,}))"
)


def secrets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Credential-shaped tokens per document; the key-block rule looks at the whole text."""
    tokens = F.filter(
        F.transform(
            F.regexp_extract_all(text, F.lit(_SECRET_START), F.lit(1)),
            lambda t: F.struct(t.alias("token"), secret_kind(t).alias("kind")),
        ),
        lambda s: s["kind"].isNotNull(),
    )
    block = F.contains(text, F.lit("-----BEGIN ")) & F.contains(text, F.lit("PRIVATE KEY-----"))
    blocks = F.when(
        block,
        F.array(F.struct(F.lit(None).cast("string").alias("token"), F.lit("private_key").alias("kind"))),
    ).otherwise(F.array().cast("array<struct<token:string,kind:string>>"))
    return docs.select(key, F.explode(F.concat(tokens, blocks)).alias("_s")).select(key, "_s.*")


# --- JSON documents -----------------------------------------------------------------------

def secrets_in_json(docs: DataFrame, key: str, doc: str, depth: int = 4) -> DataFrame:
    """First credential of each document: the top-level key that holds it and its kind.

    Strings are looked at down to ``depth`` nested levels below a top-level value.  Each level
    replaces a container by its children and passes anything else on, all inside the row's own
    task; only flagged values are shuffled.
    """
    tvf = docs.sparkSession.tvf
    parsed = docs.select(F.col(key).alias("_id"), F.try_parse_json(doc).alias("_v"))
    level = (
        parsed.lateralJoin(tvf.variant_explode(F.col("_v").outer()))
        .filter(F.col("key").isNotNull())
        .select("_id", F.col("key").alias("_top"), F.array("key").alias("_path"), F.col("value").alias("_v"))
    )
    for _ in range(depth):
        step = F.coalesce(F.col("key"), F.lpad(F.col("pos").cast("string"), 10, "0"))
        opened = F.col("value").isNotNull()
        level = level.lateralJoin(tvf.variant_explode_outer(F.col("_v").outer())).select(
            "_id", "_top",
            F.when(opened, F.concat("_path", F.array(step))).otherwise(F.col("_path")).alias("_path"),
            F.coalesce("value", "_v").alias("_v"),
        )
    text = F.when(F.schema_of_variant("_v") == "STRING", F.try_variant_get("_v", "$", "string"))
    found = level.select("_id", "_top", "_path", secret_kind(text).alias("kind")).filter("kind IS NOT NULL")
    first = F.min_by(F.struct("_top", "kind"), F.struct("_top", "_path")).alias("_f")
    return found.groupBy("_id").agg(first).select(
        F.col("_id").alias(key), F.col("_f._top").alias("top_key"), "_f.kind"
    )


def oversize_docs(docs: DataFrame, key: str, doc: str, limit: int = C.MAX_DOCUMENT_BYTES) -> DataFrame:
    """Documents over the byte limit once serialised, with their largest top-level key (null for none)."""
    sized = docs.select(key, F.try_parse_json(doc).alias("_v")).withColumn(
        "bytes", F.octet_length(F.to_json("_v")).cast("bigint")
    )
    over = sized.filter(F.col("bytes") > limit)
    parts = over.lateralJoin(docs.sparkSession.tvf.variant_explode_outer(F.col("_v").outer())).select(
        key, "bytes", F.col("key").alias("_k"),
        F.octet_length(F.to_json("value")).cast("bigint").alias("_b"),
    )
    biggest = F.max_by(F.struct("_k", "_b"), F.struct("_b", "_k")).alias("_big")
    return parts.groupBy(key, "bytes").agg(biggest).select(
        key, "bytes", F.col("_big._k").alias("largest_key"), F.col("_big._b").alias("largest_bytes")
    )


def typed_settings(docs: DataFrame, key: str, doc: str, allowed: Mapping[str, str]) -> DataFrame:
    """Allow-listed settings that carry the right type; others are rejected, not coerced.

    ``allowed`` maps a name to ``dword`` (an integer that fits 32 bits unsigned) or ``text``.
    """
    parsed = docs.select(key, F.try_parse_json(doc).alias("_v"))

    def setting(name: str, kind: str) -> Column:
        value = F.try_variant_get("_v", f"$.{name}", "variant")
        held = F.schema_of_variant(value)
        if kind == "dword":
            number = F.when(held == "BIGINT", F.try_variant_get("_v", f"$.{name}", "bigint"))
            ok = number.between(0, 4294967295)
        else:
            ok = held == "STRING"
        return F.struct(
            F.lit(name).alias("name"), F.lit(kind).alias("kind"),
            F.try_variant_get("_v", f"$.{name}", "string").alias("value"),
            F.coalesce(ok, F.lit(False)).alias("applied"), value.isNotNull().alias("present"),
        )

    settings = F.array(*[setting(n, k) for n, k in allowed.items()])
    return (
        parsed.select(key, F.explode(settings).alias("_s"))
        .select(key, "_s.*")
        .filter("present")
        .drop("present")
    )


# --- media and routing --------------------------------------------------------------------

def media_props(media: DataFrame, path: str = "path") -> DataFrame:
    """Wide tag row to (path, key, value) rows; missing and zero values give no row."""
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    positive = lambda c: F.when(F.col(c) > 0, F.col(c).cast("string"))
    sized = (F.col("width") > 0) & (F.col("height") > 0)
    is_video = category(extension(F.col(path))) == "Video"
    number = lambda c: c.cast("double").cast("string")
    lat = gps_decimal(F.col("lat_d"), F.col("lat_m"), F.col("lat_s"), F.col("lat_ref"))
    lon = gps_decimal(F.col("lon_d"), F.col("lon_m"), F.col("lon_s"), F.col("lon_ref"))
    located = lat.isNotNull() & lon.isNotNull()
    props = {
        "Image.Dimensions": F.when(sized, F.concat_ws(" x ", F.col("width").cast("string"), F.col("height").cast("string"))),
        "Image.HorizontalSize": F.when(sized, F.col("width").cast("string")),
        "Image.VerticalSize": F.when(sized, F.col("height").cast("string")),
        "Video.FrameWidth": F.when(sized & is_video, F.col("width").cast("string")),
        "Video.FrameHeight": F.when(sized & is_video, F.col("height").cast("string")),
        "Photo.CameraManufacturer": text("make"),
        "Photo.CameraModel": text("model"),
        "Image.BitDepth": positive("bit_depth"),
        "Image.HorizontalResolution": number(to_dpi(F.col("dpi_x"), F.col("res_unit"))),
        "Image.VerticalResolution": number(to_dpi(F.col("dpi_y"), F.col("res_unit"))),
        "GPS.LatitudeDecimal": F.when(located, number(lat)),
        "GPS.LongitudeDecimal": F.when(located, number(lon)),
        "Music.Artist": text("artist"),
        "Music.AlbumTitle": text("album"),
        "Title": text("title"),
        "Music.TrackNumber": positive("track"),
        "Music.Genre": text("genre"),
        "Media.Year": positive("year"),
        "Media.Duration": to_ticks(F.col("duration_ms")).cast("string"),
        "Audio.EncodingBitrate": to_bits_per_second(F.col("bitrate_kbps")).cast("string"),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in props.items()])
    return media.select(path, F.explode(pairs).alias("_p")).select(path, "_p.*").filter("value IS NOT NULL")


def tag_routes(
    files: DataFrame, template: str, dest: str, missing: str = "Unknown"
) -> DataFrame:
    """(ord, path, folder, base) requests that sort audio files by their tags."""
    from ..functions.paths import stem

    rel = template_path(expand_template(
        template, artist=F.col("artist"), album=F.col("album"), title=F.col("title"),
        track=F.col("track"), missing=missing,
    ))
    return files.select(
        "ord", "path", F.concat(F.lit(dest + "/"), rel).alias("folder"), stem(F.col("path")).alias("base")
    )


def dimension_routes(files: DataFrame) -> DataFrame:
    """(ord, path, folder, base) requests that sort pictures into ``WIDTHxHEIGHT`` folders."""
    from ..functions.paths import stem

    sub = dimension_folder(F.col("width"), F.col("height"))
    return files.select(
        "ord", "path", F.concat(folder(F.col("path")), F.lit("/"), sub).alias("folder"),
        stem(F.col("path")).alias("base"),
    )


def route_plan(requests: DataFrame, existing: DataFrame | None = None, **options) -> DataFrame:
    """Destination per routed file; files without a usable folder are skipped, not dropped."""
    from .picks import rename_plan

    # Folders are worked out once, for both branches.
    requests = pin(requests.select("ord", "path", "folder", "base"), "routes")
    usable = requests.filter(F.col("folder").isNotNull())
    skipped = requests.filter(F.col("folder").isNull()).select(
        "ord", "path", F.lit(None).cast("string").alias("destination"), F.lit("skip").alias("action")
    )
    return rename_plan(usable, existing, **options).unionByName(skipped)


def page_manifest(
    pages: DataFrame, output: str, path: str
) -> DataFrame:
    """0-based page index in natural order and page count per combined output; page 0 is the cover."""
    keyed = pages.withColumn("_k", natural_key(file_name(F.col(path))))
    placed = ordered_prefix(
        keyed, [output], [F.col("_k"), F.col(path)], number="_n", total="page_count"
    )
    return placed.select(
        *pages.columns, (F.col("_n") - 1).alias("page"), "page_count", (F.col("_n") == 1).alias("is_cover")
    )
