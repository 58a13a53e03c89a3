"""Array helpers that keep work inside one row (no shuffle)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


def _scan(values: Column, start: Column) -> Column:
    """Running sums of a short array, seeded with ``start`` (``start`` itself is dropped)."""
    empty = F.array().cast("array<bigint>")
    folded = F.aggregate(
        values,
        F.struct(start.cast("bigint").alias("sum"), empty.alias("out")),
        lambda acc, v: F.struct(
            (acc["sum"] + v).alias("sum"), F.concat(acc["out"], F.array(acc["sum"] + v)).alias("out")
        ),
    )
    return folded["out"]


def prefix_sums(values: Column) -> Column:
    """Inclusive running sums of an ``array<bigint>``.

    Two levels of blocks: a single fold would copy its growing result once per
    element, which is quadratic in a long document's hit count.
    """
    def blocks_of(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(v), F.lit(_BLOCK))
        return F.transform(starts, lambda s: F.slice(v, s, _BLOCK))

    def total(block: Column) -> Column:
        return F.aggregate(block, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def stitched(blocks: Column) -> Column:
        totals = F.transform(blocks, total)
        return let(
            _scan(totals, F.lit(0)),
            lambda ends: F.flatten(
                F.transform(
                    F.arrays_zip(blocks.alias("b"), ends.alias("e")),
                    lambda z: _scan(z["b"], z["e"] - total(z["b"])),
                )
            ),
        )

    def summed(v: Column) -> Column:
        empty = F.array().cast("array<bigint>")
        return F.when(F.size(v) > 0, let(blocks_of(v), stitched)).otherwise(empty)

    return let(F.transform(values, lambda x: x.cast("bigint")), summed)
