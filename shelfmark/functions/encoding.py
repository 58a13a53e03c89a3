"""Bytes of unknown encoding to text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType

from .arrays import let
from .text import script_profile, script_score

# Legacy double-byte code pages in order of preference: fixed values.
LEGACY_CODECS = ("gbk", "cp932", "cp949", "big5")
# Byte order branches: codec, bytes of mark to skip, bytes per unit.
WIDE_CODECS = {
    "utf-32le": ("utf-32-le", 4, 4),
    "utf-32be": ("utf-32-be", 4, 4),
    "utf-16le": ("utf-16-le", 2, 2),
    "utf-16be": ("utf-16-be", 2, 2),
    "utf-16le-sniffed": ("utf-16-le", 0, 2),
    "utf-16be-sniffed": ("utf-16-be", 0, 2),
}


def _readings(kind: str | None, content: bytes | None) -> list[str | None] | None:
    """Every reading worth scoring: one for a wide encoding, one per code page otherwise."""
    if kind is None or content is None:
        return None
    raw = bytes(content)
    if kind in WIDE_CODECS:
        codec, skip, unit = WIDE_CODECS[kind]
        return [raw[skip : len(raw) - (len(raw) - skip) % unit].decode(codec, "replace")]
    out: list[str | None] = []
    for codec in LEGACY_CODECS:
        try:
            out.append(raw.decode(codec))
        except UnicodeDecodeError:
            out.append(None)
    return out + [raw.decode("cp1252", "replace")]


@F.pandas_udf(ArrayType(StringType()))
def _decode_readings(asked: pd.DataFrame) -> pd.Series:
    return pd.Series([_readings(k, c) for k, c in zip(asked["kind"], asked["content"])], dtype=object)


def _utf16_parity(content: Column) -> Column:
    """'le' or 'be' when most two-byte units of the first 4 KB carry a zero in the same place."""
    head = F.substring(content, 1, 4096)
    digits = F.hex(head)
    pairs = F.floor(F.octet_length(head) / 2)
    limit = F.floor(pairs * 3 / 5)

    def units(pattern: str) -> Column:
        # Every match takes one aligned unit; units of the wanted form vanish.
        rest = F.regexp_replace(digits, rf"(?:{pattern})|(.{{1,4}})", "$1")
        return (F.length(digits) - F.length(rest)) / 4

    le, be = units("(?!00)..00"), units("00(?!00)..")
    return F.when(
        (pairs >= 8) & F.contains(head, F.unhex(F.lit("00"))),
        F.when((le > limit) & ~(be > limit), "le").when((be > limit) & ~(le > limit), "be"),
    )


def text_encoding(content: Column) -> Column:
    """Which branch decodes these bytes."""
    first2, first3, first4 = (F.hex(F.substring(content, 1, n)) for n in (2, 3, 4))
    parity = _utf16_parity(content)
    return (
        F.when(first3 == "EFBBBF", "utf-8-bom")
        .when(first4 == "FFFE0000", "utf-32le")
        .when(first4 == "0000FEFF", "utf-32be")
        .when(first2 == "FFFE", "utf-16le")
        .when(first2 == "FEFF", "utf-16be")
        .when(parity == "le", "utf-16le-sniffed")
        .when(parity == "be", "utf-16be-sniffed")
        .when(F.is_valid_utf8(content.cast("string")), "utf-8")
        .otherwise("legacy")
    )


def _wide_body(raw: Column, kind: Column) -> Column:
    """The whole two-byte units behind the mark."""
    skip = F.when(kind.endswith("-sniffed"), 0).otherwise(2)
    return F.substring(raw, skip + 1, (F.floor((F.octet_length(raw) - skip) / 2) * 2).cast("int"))


def _has_surrogate(raw: Column, kind: Column) -> Column:
    """Whether UTF-16 bytes have surrogate units; those without are read by the JVM."""
    digits = F.hex(_wide_body(raw, kind))
    return F.when(kind.startswith("utf-16le"), digits.rlike("^(?:....)*?..D[89A-F]")).otherwise(
        digits.rlike("^(?:....)*?D[89A-F]..")
    )


def decode_text(content: Column, cap: int | None = None) -> Column:
    """Bytes to text: marks first, then the UTF-16 pattern, strict UTF-8, and legacy code pages.

    UTF-8, and UTF-16 without surrogates, never leave the JVM.  Other rows are decoded in Arrow batches, and their candidate
    readings are scored back in Spark: the best plausible one wins, ties go to the earlier page.
    """
    raw = content if cap is None else F.substring(content, 1, cap)

    # What goes to Python is told without a lambda, which a function of Python cannot have in its arguments.
    kind = text_encoding(raw)
    there = kind.isin("utf-8", "utf-8-bom") | (kind.startswith("utf-16") & ~_has_surrogate(raw, kind))
    readings = _decode_readings(F.struct(F.when(~there, kind).alias("kind"), F.when(~there, raw).alias("content")))

    def in_jvm(kind: Column) -> Column:
        body = F.substring(raw, F.lit(4), F.octet_length(raw))
        return (
            F.when(kind == "utf-8", raw.cast("string"))
            .when(kind == "utf-8-bom", F.make_valid_utf8(body.cast("string")))
            .when(kind.startswith("utf-16le"), F.decode(_wide_body(raw, kind), "UTF-16LE"))
            .when(kind.startswith("utf-16be"), F.decode(_wide_body(raw, kind), "UTF-16BE"))
        )

    def chosen(found: Column) -> Column:
        scored = F.transform(
            F.slice(found, 1, len(LEGACY_CODECS)),
            lambda text, i: F.struct(
                script_score(script_profile(text)).alias("score"), (-i).alias("rank"), text.alias("text")
            ),
        )
        best = F.array_max(F.filter(scored, lambda s: s["score"] > 0))["text"]
        # A legacy text has a reading for every code page, any other one.
        return (
            F.when(found.isNull(), let(text_encoding(raw), in_jvm))
            .when(F.size(found) > 1, F.coalesce(best, F.element_at(found, -1)))
            .otherwise(F.get(found, 0))
        )

    return let(readings, chosen)
