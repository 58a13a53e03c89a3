"""Paths, extensions and what they stand for."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as C

_BY_CATEGORY = (
    ("Ebook", C.EBOOK_EXTS),
    ("Document", C.DOCUMENT_EXTS),
    ("Audio", C.AUDIO_EXTS),
    ("Raw", C.RAW_EXTS),
    ("Video", C.VIDEO_EXTS),
    ("Archive", C.ARCHIVE_EXTS),
)
DEFAULT_KNOWN = frozenset(C.DEFAULT_IMAGE_EXTS).union(*(exts for _, exts in _BY_CATEGORY))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def extension(path: Column) -> Column:
    """Lower-cased extension; empty for none, and for a name that only starts with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/\\]\.([^./\\]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def category(ext: Column) -> Column:
    """Category of an extension; anything unlisted counts as an image."""
    out = None
    for name, exts in _BY_CATEGORY:
        test = ext.isin(*exts)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("Image")


def category_label(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for key, label in C.CATEGORY_LABELS.items():
        out = F.when(name == key, label).otherwise(out)
    return out


def format_table(spark: SparkSession, known: Iterable[str] = DEFAULT_KNOWN) -> DataFrame:
    """The registry as a table: extension and the label of its category."""
    exts = spark.createDataFrame([(e,) for e in sorted(known)], "ext string")
    return exts.select("ext", category_label(category(F.col("ext"))).alias("category"))


def is_known(ext: Column, known: Iterable[str] = DEFAULT_KNOWN) -> Column:
    """Membership in the registry (a parameter: pass the extensions you register)."""
    return F.lower(ext).isin(*sorted(known))


def verb_gate(ext: Column, known: Iterable[str] = DEFAULT_KNOWN) -> Column:
    """Which verbs apply: pictures are any known format but archives; audio by category."""
    low = F.lower(ext)
    return F.struct(
        (is_known(low, known) & ~low.isin(*C.ARCHIVE_EXTS)).alias("is_image"),
        (category(low) == "Audio").alias("is_audio"),
    )


def content_kind(
    path: Column,
    is_dir: Column,
    head: Column,
    *,
    markdown: bool = True,
    text: bool = True,
    known: Iterable[str] = DEFAULT_KNOWN,
) -> Column:
    """Ordered viewer decision; ``markdown``/``text`` are the user's two switches."""
    from .signatures import is_binary, is_image_signature

    ext = extension(path)
    md, txt = F.lit(markdown), F.lit(text)
    doc_on = F.when(ext == "ipynb", md).otherwise(txt)
    return (
        F.when(is_dir, "InfoCard")
        .when(md & ext.isin(*C.MARKDOWN_EXTS), "Markdown")
        .when(ext.isin(*C.DOC_EXTS) & doc_on, "Markdown")
        .when(txt & ext.isin(*C.TEXT_EXTS), "Text")
        .when(is_known(ext, known) & category(ext).isin("Video", "Audio"), "Video")
        .when(is_known(ext, known), "Image")
        .when(txt & (F.octet_length(head) > 0) & ~is_binary(head), "Text")
        .when(is_image_signature(head), "Image")
        .otherwise("InfoCard")
    )


def _lookup(value: Column, table: Mapping[str, Iterable[str]], otherwise: Column) -> Column:
    out = otherwise
    for lang, names in table.items():
        out = F.when(value.isin(*names), lang).otherwise(out)
    return out


def language_from_ext(ext: Column) -> Column:
    return _lookup(F.lower(ext), C.LANG_BY_EXT, F.lit("plain"))


def language_from_fence(tag: Column) -> Column:
    low = F.lower(tag)
    return _lookup(low, C.LANG_BY_FENCE, language_from_ext(low))


def language_from_shebang(text: Column) -> Column:
    """Interpreter of a ``#!`` first line, looking through ``env``."""
    first = F.regexp_extract(text, r"^#!([^\r\n]*)", 1)
    interp = F.lower(F.regexp_extract(F.rtrim(first), r"([^/]*)$", 1))
    prog = F.regexp_extract(interp, r"^\s*(?:env\s+)?(\S*)", 1)
    return (
        F.when((prog == "sh") | prog.rlike("^(?:bash|zsh|dash)"), "sh")
        .when(prog.startswith("python"), "py")
        .when(prog.startswith("node"), "js")
        .when(prog.startswith("ruby"), "ruby")
        .when(prog.startswith("php"), "php")
        .otherwise("plain")
    )


def code_language(path: Column, text: Column) -> Column:
    """Extension first, then the exact file name, then a shebang line."""
    by_ext = language_from_ext(extension(path))
    by_name: dict[str, list[str]] = {}
    for name, lang in C.LANG_BY_NAME.items():
        by_name.setdefault(lang, []).append(name)
    named = _lookup(F.lower(file_name(path)), by_name, language_from_shebang(text))
    return F.when(by_ext != "plain", by_ext).otherwise(named)
