"""Sorting, top-k and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import TIER_ORDER


def listing_order(entries: DataFrame) -> DataFrame:
    """Folders first, then case-insensitive path."""
    return entries.orderBy(F.col("is_dir").desc(), F.lower("name"), "name")


def slowest_k(df: DataFrame, by: str, k: int, tie: str = "name") -> DataFrame:
    """Top ``k`` by a measure, ties by name."""
    return df.orderBy(F.col(by).desc(), F.col(tie)).limit(k)


def first_n_of_m(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows together with the exact total."""
    return df.orderBy(*order).limit(n).withColumn("total", df.agg(F.count("*")).scalar())


def truncation_note(shown: Column, total: Column, noun: str = "rows") -> Column:
    """``Showing the first N of M rows.`` when something was left out."""
    note = F.concat(
        F.lit("Showing the first "), shown.cast("string"), F.lit(" of "), total.cast("string"),
        F.lit(f" {noun}."),
    )
    return F.when(total > shown, note)


def tier_rank(tier: Column, tiers: Sequence[str] = TIER_ORDER) -> Column:
    """Position of a tier in the fixed order; unknown tiers come last."""
    position = F.array_position(F.array(*[F.lit(t) for t in tiers]), tier)
    return F.when(F.coalesce(position, F.lit(0)) == 0, len(tiers) + 1).otherwise(position)


def tier_order(df: DataFrame, tier: str, *before: str, tiers: Sequence[str] = TIER_ORDER) -> DataFrame:
    return df.orderBy(*before, tier_rank(F.col(tier), tiers))


def union_corpora(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two sample sets appended, duplicates kept."""
    return a.unionByName(b)


def distinct_set(df: DataFrame, *keys: str) -> DataFrame:
    """Sorted distinct keys."""
    return df.select(*keys).distinct().orderBy(*keys)


def set_difference(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Distinct expected keys that are not present.

    Both sides are tagged and folded per key, so repeated keys collapse before the shuffle.
    """
    tagged = expected.select(key, F.lit(False).alias("_p")).unionByName(
        present.select(key, F.lit(True).alias("_p"))
    )
    return tagged.groupBy(key).agg(F.bool_or("_p").alias("_p")).filter(~F.col("_p")).select(key)
