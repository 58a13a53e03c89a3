"""Sizes, resize requests, versions and buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from ..constants import DEFAULT_BUCKET, SIZE_BUCKETS

_UNITS = ("KB", "MB", "GB", "TB")
_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def human_size(n_bytes: Column) -> Column:
    """``1536 -> '1.5 KB'``: base 1024, one decimal, half-even like the published rule."""
    out = F.concat(n_bytes.try_cast("bigint").cast("string"), F.lit(" B"))
    for power, unit in enumerate(_UNITS, start=1):
        scaled = n_bytes.cast("double") / float(1024**power)
        text = F.concat(F.format_string("%.1f", F.bround(scaled, 1)), F.lit(f" {unit}"))
        out = F.when(n_bytes < 1024**power, out).otherwise(text) if power == 1 else F.when(
            n_bytes >= 1024**power, text
        ).otherwise(out)
    return F.when(n_bytes.isNotNull(), out)


def parse_size(text: Column) -> Column:
    """``'1MB'``, ``'500kb'``, ``'800000'`` to bytes (decimal units); NULL when not a positive size."""
    core = F.regexp_replace(F.lower(F.trim(text)), "b$", "")
    number = F.trim(F.regexp_replace(core, "[mk]$", ""))
    factor = F.when(core.endswith("m"), 1e6).when(core.endswith("k"), 1e3).otherwise(1.0)
    value = F.when(number.rlike(_NUMBER), number).try_cast("double") * factor
    return F.when(value > 0, F.floor(value).try_cast("bigint"))


def parse_resize(text: Column) -> Column:
    """``'800x600'`` or ``'50%'`` to a struct; NULL fields when the request is malformed."""
    value = F.trim(text)
    percent = F.regexp_extract(value, r"^(\d+)\s*%$", 1).try_cast("int")
    width = F.regexp_extract(value, r"^\s*(\d+)\s*[xX]\s*(\d+)\s*$", 1).try_cast("int")
    height = F.regexp_extract(value, r"^\s*(\d+)\s*[xX]\s*(\d+)\s*$", 2).try_cast("int")
    both = width.isNotNull() & height.isNotNull()
    return F.struct(
        F.when(percent.isNotNull(), F.least(F.greatest(percent, F.lit(1)), F.lit(1000))).alias("percent"),
        F.when(both, F.greatest(width, F.lit(1))).alias("width"),
        F.when(both, F.greatest(height, F.lit(1))).alias("height"),
    )


def fit_dims(width: Column, height: Column, resize: Column) -> Column:
    """Target size for a resize request; fitting keeps the aspect ratio and never enlarges."""
    w, h = width.cast("double"), height.cast("double")
    share = resize["percent"] / 100.0
    scale = F.least(resize["width"] / w, resize["height"] / h)

    def target(side: Column) -> Column:
        by_percent = F.greatest(F.round(side * share), F.lit(1.0))
        by_box = F.when(
            (w > resize["width"]) | (h > resize["height"]),
            F.greatest(F.round(side * scale), F.lit(1.0)),
        ).otherwise(side)
        return (
            F.when(resize["percent"].isNotNull(), by_percent)
            .when(resize["width"].isNotNull(), by_box)
            .otherwise(side)
            .cast("bigint")
        )

    return F.struct(target(w).alias("width"), target(h).alias("height"))


def dimension_folder(width: Column, height: Column) -> Column:
    """``640x480``; NULL when either side is unknown."""
    return F.concat(width.cast("string"), F.lit("x"), height.cast("string"))


def parse_version(text: Column) -> Column:
    """Tolerant ``v1.2.3-rc1`` to a comparable struct; NULL when the major part is not a number."""
    core = F.regexp_replace(F.trim(text), "^[vV]+", "")
    parts = F.split(F.regexp_extract(core, r"^([^+-]*)", 1), r"\.")

    def part(i: int) -> Column:
        raw = F.get(parts, i)
        number = F.when(raw.rlike(r"^\+?\d+$"), raw).try_cast("bigint")
        return F.when(number <= 4294967295, number)

    fields = [part(0).alias("major")] + [
        F.coalesce(part(i), F.lit(0)).cast("bigint").alias(name)
        for i, name in ((1, "minor"), (2, "patch"))
    ]
    return F.when(part(0).isNotNull(), F.struct(*fields))


def is_newer(candidate: Column, current: Column) -> Column:
    """Strictly newer; FALSE when either version does not parse."""
    return F.coalesce(parse_version(candidate) > parse_version(current), F.lit(False))


def snap_to_bucket(size: Column, buckets: Sequence[int] = SIZE_BUCKETS) -> Column:
    """The smallest bucket at least ``size``, clamped to the largest; NULL for sizes <= 0."""
    ordered = sorted(buckets)
    snapped = F.lit(ordered[-1])
    for bucket in reversed(ordered[:-1]):
        snapped = F.when(size <= bucket, bucket).otherwise(snapped)
    return F.when(size > 0, snapped)


def normalize_sizes(sizes: Column, buckets: Sequence[int] = SIZE_BUCKETS) -> Column:
    """An array of requested sizes to distinct ascending buckets; nothing usable gives the default."""
    kept = F.array_sort(
        F.array_distinct(
            F.filter(F.transform(sizes, lambda s: snap_to_bucket(s, buckets)), lambda s: s.isNotNull())
        )
    )
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(DEFAULT_BUCKET)))


def build_order(sizes: Column) -> Column:
    """Largest bucket first."""
    return F.sort_array(sizes, asc=False)


def size_over_limit(length: Column, user_limit: Column, hard_limit: Column) -> Column:
    """Reason text when a file is over the effective limit, NULL otherwise."""
    limit = F.least(user_limit, hard_limit)
    reason = F.concat(
        F.lit("input is "), length.cast("string"),
        F.lit(" bytes, over the effective limit of "), limit.cast("string"), F.lit(" bytes"),
    )
    return F.when(length > limit, reason)
