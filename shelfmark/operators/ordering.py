"""Positions and running totals that stay correct and spread out when one group is huge."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.paths import file_name
from ..scratch import pin

_DIGITS = 18


def natural_key(name: Column) -> Column:
    """Sort key that puts ``page2`` before ``page10``, as one text that compares byte by byte.

    Digit runs are padded to a fixed width; a longer run is written as its length and digits
    behind a ``:``, which sorts after every shorter number.  A zero byte ends each run, so a
    shorter run of letters comes first, whatever follows it.
    """
    low = F.lower(name)
    padded = F.regexp_replace(low, r"(\d+)", "\u0000" + "0" * _DIGITS + "$1\u0000")
    padded = F.regexp_replace(padded, rf"\d*(\d{{{_DIGITS}}})", "$1")
    tokens = F.regexp_extract_all(low, F.lit(r"(\d+|\D+)"), F.lit(1))

    def long_token(token: Column) -> Column:
        digits = F.regexp_replace(token, "^0+", "")
        counted = F.concat(F.lit(":"), F.lpad(F.length(digits).cast("string"), 6, "0"), digits)
        number = F.when(F.length(digits) > _DIGITS, counted).otherwise(F.lpad(digits, _DIGITS, "0"))
        return F.when(
            token.rlike(r"^\d"), F.concat(F.lit("\u0000"), number, F.lit("\u0000"))
        ).otherwise(token)

    any_length = F.array_join(F.transform(tokens, long_token), "")
    key = F.when(low.rlike(rf"\d{{{_DIGITS + 1}}}"), any_length).otherwise(padded)
    return F.regexp_replace(key, "^\u0000", "")


def cover_key(name: Column) -> Column:
    """Natural key with ``[`` sorted behind ``z``."""
    return natural_key(F.replace(name, F.lit("["), F.lit("{")))


def natural_order(df: DataFrame, path: str) -> DataFrame:
    """Sort by file name the way a file manager does; the full path breaks ties."""
    return (
        df.withColumn("_natural", natural_key(file_name(F.col(path))))
        .orderBy("_natural", path)
        .drop("_natural")
    )


def _slices(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows in key and order, cut into slices (``_slice``) and numbered inside them (``_pos``).

    The slice numbers must not change between two uses, whatever is recomputed: they are pinned.
    """
    ranged = (
        df.repartitionByRange(*[F.col(k) for k in keys], *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_pos", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_pos", 33))
    )
    return pin(ranged, "slices")


def _offsets(pinned: DataFrame, keys: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """What stands before each piece of a group that a slice border cuts: at most two rows per slice."""
    pieces = pinned.groupBy("_slice", *keys).agg(
        F.count("*").alias("_n"), F.min("_pos").alias("_o_first"), F.max("_pos").alias("_o_last"),
        *[F.sum(f"_v_{name}").alias(f"_s_{name}") for name in sums],
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    return pieces.select(
        F.col("_slice").alias("_o_slice"), "_o_first", "_o_last",
        *[F.col(k).alias(f"_o_{k}") for k in keys],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o_n"),
        F.sum("_n").over(whole).alias("_o_total"),
        F.count("*").over(whole).alias("_o_pieces"),
        *[F.sum(f"_s_{name}").over(before).alias(f"_o_s_{name}") for name in sums],
    ).filter(F.col("_o_pieces") > 1)


def _same_piece(keys: Sequence[str]) -> Column:
    match = F.col("_slice") == F.col("_o_slice")
    return reduce(and_, [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys], match)


def ordered_prefix(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    *,
    number: str = "rn",
    total: str | None = None,
    sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add a 1-based position, the group size and inclusive running sums per group.

    ``order`` must be a total order within each group.  Rows are range-partitioned over the keys
    *and* the order, so a hot group is cut into many slices; each slice is numbered on its own and
    shifted by what the slices before it hold.
    """
    sums = dict(sums or {})
    pinned = _slices(df.withColumns({f"_v_{name}": value for name, value in sums.items()}), keys, order)
    piece = Window.partitionBy("_slice", *keys)
    running = piece.orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    local = pinned.withColumns(
        {number: F.row_number().over(piece.orderBy("_pos")).cast("bigint"),
         "_size": F.count("*").over(piece)}
        | {name: F.sum(f"_v_{name}").over(running) for name in sums}
    )
    offsets = _offsets(pinned, keys, sums)
    # At most two rows per slice, so broadcasting is safe.
    joined = local.join(F.broadcast(offsets), _same_piece(keys), "left")
    zero = F.lit(0)
    shifted = {number: F.col(number) + F.coalesce(F.col("_o_n"), zero)} | {
        name: F.when(F.col(f"_o_s_{name}").isNull(), F.col(name)).otherwise(
            F.coalesce(F.col(name), zero) + F.col(f"_o_s_{name}")
        )
        for name in sums
    }
    if total:
        shifted[total] = F.coalesce(F.col("_o_total"), F.col("_size"))
    extra = [number, *sums] + ([total] if total else [])
    return joined.withColumns(shifted).select(*df.columns, *extra)


def ordered_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    value: str,
    shifts: Mapping[str, int],
    *,
    number: str = "rn",
    total: str = "n",
) -> DataFrame:
    """Per row the value some places ahead in its group, or one place back, wrapping at both ends.

    ``shifts`` maps an output name to places ahead (-1: one back); position and group size come
    along.  ``order`` must be a total order within each group.  Inside a slice a neighbour is a
    ``lead`` or ``lag``; a group inside one slice wraps there.  Only the border rows of cut groups
    travel further: a few per slice, so broadcasting them is safe.
    """
    if any(s < -1 or s == 0 for s in shifts.values()):
        raise ValueError("shifts are 1 or more places ahead, or -1")
    pinned = _slices(df, keys, order)
    offsets = _offsets(pinned, keys)
    ahead = max([1, *shifts.values()])
    box = F.struct(F.col(value).alias("value"))
    by_pos = Window.partitionBy("_slice", *keys).orderBy("_pos")
    whole = by_pos.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    local = pinned.withColumns(
        {number: F.row_number().over(by_pos).cast("bigint"), "_size": F.count("*").over(whole),
         "_heads": F.array(*[F.nth_value(box, k + 1).over(whole) for k in range(ahead)]),
         "_tail": F.last(box).over(whole)}
        | {f"_near_{name}": (F.lead(box, s) if s > 0 else F.lag(box, 1)).over(by_pos) for name, s in shifts.items()}
    )
    borders = pinned.join(F.broadcast(offsets), _same_piece(keys)).filter(
        (F.col("_pos") - F.col("_o_first") < ahead) | (F.col("_pos") == F.col("_o_last"))
    )
    own = F.col("_pos") - F.col("_o_first") + F.col("_o_n")
    sent = borders.select(
        *[F.col(k).alias(f"_f_{k}") for k in keys], box.alias("_box"),
        F.explode(F.array(*[
            F.struct((F.pmod(own - s, F.col("_o_total")) + 1).alias("to"), F.lit(name).alias("role"))
            for name, s in shifts.items()
        ])).alias("_at"),
    )
    fills = sent.groupBy(*[f"_f_{k}" for k in keys], F.col("_at.to").alias("_f_to")).agg(*[
        F.first(F.when(F.col("_at.role") == name, F.col("_box")), ignorenulls=True).alias(f"_far_{name}")
        for name in shifts
    ])
    placed = local.join(F.broadcast(offsets), _same_piece(keys), "left").withColumns({
        number: F.col(number) + F.coalesce(F.col("_o_n"), F.lit(0)),
        total: F.coalesce(F.col("_o_total"), F.col("_size")),
    })
    match = reduce(
        and_, [F.col(k).eqNullSafe(F.col(f"_f_{k}")) for k in keys], F.col(number) == F.col("_f_to")
    )

    def found(name: str, shift: int) -> Column:
        around = F.get("_heads", F.pmod(F.col(number) - 1 + shift, F.col(total)).cast("int")) if shift > 0 else F.col("_tail")
        inside = F.when(F.col("_o_n").isNull(), around)
        return F.coalesce(F.col(f"_near_{name}"), F.col(f"_far_{name}"), inside)["value"].alias(name)

    return placed.join(F.broadcast(fills), match, "left").select(
        *df.columns, number, total, *[found(name, s) for name, s in shifts.items()]
    )


def rank_values(
    df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Column]
) -> DataFrame:
    """Exact order statistics per group without sorting a group in one task.

    ``ranks`` maps an output name to a 1-based rank written over the group's row count ``n``.
    Equal values are counted first; a coarse, order-preserving bucket of the value locates each
    rank, and only the buckets that hold one are looked at value by value.  A bucket spans about a
    hundred-thousandth of a value, so that values close together still spread.
    """
    v = F.col("_v")
    hist = (
        df.select(*keys, F.col(value).cast("double").alias("_v"))
        .filter(v.isNotNull())
        .groupBy(*keys, "_v")
        .agg(F.count("*").alias("_n"))
        .withColumn("_bucket", (F.signum(v) * F.floor(F.log1p(F.abs(v) * 1e6) * 1e5)).cast("bigint"))
        .withColumn("_all", F.lit(0))
    )
    group = ["_all", *keys]
    upto = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    coarse = (
        hist.groupBy(*group, "_bucket")
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(upto))
        .withColumn("n", F.sum("_n").over(Window.partitionBy(*group)))
        .withColumn(
            "_want",
            F.explode(F.array(*[
                F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank"))
                for name, rank in ranks.items()
            ])),
        )
        .filter(F.col("_want.rank").between(F.col("_upto") - F.col("_n") + 1, F.col("_upto")))
        .select(
            *group, "_bucket", "n", F.col("_want.name").alias("_name"),
            (F.col("_want.rank") - F.col("_upto") + F.col("_n")).alias("_left"),
        )
    )
    inside = (
        Window.partitionBy(*group, "_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    )
    there = coarse.select(*[F.col(c).alias(f"_c{c}") for c in [*group, "_bucket"]], "n", "_name", "_left")
    match = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_c{c}")) for c in [*group, "_bucket"]])
    return (
        hist.join(there, match)
        .withColumn("_seen", F.sum("_n").over(inside))
        .filter(F.col("_seen") >= F.col("_left"))
        .groupBy(*group)
        .agg(
            F.max("n").alias("n"),
            *[F.min(F.when(F.col("_name") == name, v)).alias(name) for name in ranks],
        )
        .drop("_all")
    )
