"""Rules over the first bytes of a file."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import constants as C
from .arrays import let


# Longest reach of any signature.
_REACH = max(offset + len(sig) // 2 for _, parts in C.SIGNATURES for offset, sig in parts)


def _matches(head_hex: Column, parts: tuple[tuple[int, str], ...]) -> Column:
    test = None
    for offset, sig in parts:
        here = F.substring(head_hex, offset * 2 + 1, len(sig)) == sig
        test = here if test is None else test & here
    return test


def magic_kind(head: Column) -> Column:
    """First matching fixed-offset signature, NULL when none matches."""
    head_hex = F.hex(F.substring(head, 1, _REACH))
    out = None
    for kind, parts in C.SIGNATURES:
        test = _matches(head_hex, parts)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def is_image_signature(head: Column) -> Column:
    return F.coalesce(magic_kind(head).isin(*C.IMAGE_SIGNATURES), F.lit(False))


def is_binary(content: Column) -> Column:
    """Two zero bytes in a row, the first of them within 16 KB."""
    return F.contains(F.substring(content, 1, C.TEXT_SNIFF_BYTES + 1), F.unhex(F.lit("0000")))


def read_head(content: Column, length: Column, cap: int) -> Column:
    """First ``cap`` bytes and whether the file was longer."""
    return F.struct(F.substring(content, 1, cap).alias("head"), (length > cap).alias("was_longer"))


# Where four formats keep their size: signature, width offset, height offset, bytes, byte order.
# Fixed values.
_DIMENSIONS = (
    ("psd", 18, 14, 4, False),
    ("png", 16, 20, 4, False),
    ("gif", 6, 8, 2, True),
    ("bmp", 18, 22, 4, True),
)
_DIMENSION_REACH = 26


def _uint(head_hex: Column, offset: int, size: int, little: bool) -> Column:
    digits = F.substring(head_hex, offset * 2 + 1, size * 2)
    if little:
        digits = F.concat(
            *[F.substring(head_hex, (offset + i) * 2 + 1, 2) for i in range(size - 1, -1, -1)]
        )
    value = F.conv(digits, 16, 10).cast("bigint")
    return F.when((F.length(digits) == size * 2) & (value > 0), value)


def header_dims(head: Column) -> Column:
    """Pixel size from fixed header bytes (PSD, PNG, GIF, BMP); NULL when either side is unknown."""
    head_hex = F.hex(F.substring(head, 1, _DIMENSION_REACH))
    out = None
    for kind, w_at, h_at, size, little in _DIMENSIONS:
        test = F.lit(False)
        for name, parts in C.SIGNATURES:
            if name == kind:
                test = test | _matches(head_hex, parts)
        width, height = (_uint(head_hex, at, size, little) for at in (w_at, h_at))
        dims = F.when(
            width.isNotNull() & height.isNotNull(),
            F.struct(width.alias("width"), height.alias("height")),
        )
        out = F.when(test, dims) if out is None else out.when(test, dims)
    return out


def junk_sample(content: Column) -> Column:
    """Too short, an HTML error page, a refusal body or an un-pulled pointer file."""
    head = F.decode(F.substring(content, 1, 256), "ISO-8859-1")
    return (
        (F.octet_length(content) < 64)
        | head.rlike(r"(?im)^\s*<!doctype\s+html")
        | head.rlike(r"(?im)^\s*<html[\s>]")
        | head.rlike(r"(?i)404:?\s*Not Found|Access Denied|<Error>")
        | head.rlike(r"(?i)^version https://git-lfs")
    )


def xmp_facts(content: Column) -> Column:
    """Labelled facts of the XMP packet inside any container, as an array of (label, value)."""
    raw = F.decode(content, "ISO-8859-1")
    latin = F.regexp_extract(raw, r"(?s)(<x:xmpmeta.*?</x:xmpmeta>)", 1)
    packet = F.make_valid_utf8(F.encode(latin, "ISO-8859-1").cast("string"))
    return let(packet, _packet_facts)


def _packet_facts(packet: Column) -> Column:

    def clean(text: Column) -> Column:
        out = F.trim(text)
        for name in ("amp", "lt", "gt", "quot", "apos"):
            out = F.replace(out, F.lit(f"&{name};"), F.lit(C.ENTITIES[name]))
        out = F.trim(out)
        return F.nullif(out, F.lit(""))

    def single(prop: str) -> Column:
        attr = F.regexp_extract_all(packet, F.lit(rf'{prop}="([^"]*)"'), F.lit(1))
        elem = F.regexp_extract_all(packet, F.lit(rf"(?s)<{prop}>(.*?)</"), F.lit(1))
        found = F.when(F.size(attr) > 0, F.get(attr, 0)).otherwise(F.get(elem, 0))
        return clean(found)

    attrs = F.regexp_extract_all(packet, F.lit(rf'{C.XMP_PERSON}="([^"]*)"'), F.lit(1))
    elems = F.regexp_extract_all(packet, F.lit(rf"(?s)<{C.XMP_PERSON}>(.*?)</"), F.lit(1))
    people = F.array_distinct(
        F.filter(F.transform(F.concat(attrs, elems), clean), lambda p: p.isNotNull())
    )
    facts = [
        F.struct(F.lit(label).alias("label"), single(prop).alias("value"))
        for label, prop in C.XMP_PROPERTIES
    ]
    facts.append(
        F.struct(
            F.lit("People").alias("label"),
            F.when(F.size(people) > 0, F.array_join(people, ", ")).alias("value"),
        )
    )
    return F.filter(F.array(*facts), lambda f: f["value"].isNotNull())
