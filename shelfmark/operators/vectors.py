"""Statistics over sample vectors, inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import constants as C
from ..functions.arrays import let


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v.cast("double"))
    return total / F.size(values)


def sample_sd(values: Column) -> Column:
    """Population standard deviation; NULL for an empty vector."""
    def around(mean: Column) -> Column:
        squares = F.transform(values, lambda v: (v.cast("double") - mean) * (v.cast("double") - mean))
        return F.sqrt(let(squares, _mean))

    return F.when(F.size(values) > 0, let(_mean(values), around))


def channel_sd(samples: Column) -> Column:
    """Largest standard deviation of any channel of an array of channel arrays."""
    def of(n: Column) -> Column:
        return sample_sd(F.transform(samples, lambda s: F.get(s, n)))

    channels = F.sequence(F.lit(0), F.size(F.get(samples, 0)) - 1)
    return F.when(F.size(samples) > 0, F.array_max(F.transform(channels, of)))


def is_flat(values: Column) -> Column:
    return sample_sd(values) < C.FLAT_SD


def mean_abs_delta(a: Column, b: Column) -> Column:
    """Mean absolute difference of two aligned vectors."""
    return let(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), _mean)


def trailing_flat(values: Column) -> Column:
    """Share of trailing positions equal to the last value; a wholly flat vector gives 0."""
    last = F.element_at(values, -1)

    def share(first_other: Column) -> Column:
        flat = (F.size(values) == 0) | (first_other == 0)
        return F.when(flat, 0.0).otherwise((first_other - 1) / F.size(values))

    return let(F.array_position(F.transform(F.reverse(values), lambda v: v != last), True), share)


def is_fill(values: Column) -> Column:
    """Is the last sample the neutral fill a truncated decode leaves behind?

    A sample is a number or an array of channels, of which each must be near the grey and all
    near one another.
    """
    def grey(channels: Column) -> Column:
        near = F.forall(channels, lambda c: F.abs(c - C.FILL_GREY) <= C.FILL_TOLERANCE)
        return near & (F.array_max(channels) - F.array_min(channels) <= C.FILL_SPREAD)

    return let(F.flatten(F.array(F.element_at(values, -1))), grey)


def is_fill_value(values: Column) -> Column:
    """:func:`is_fill` for samples of one channel."""
    return F.abs(F.element_at(values, -1) - C.FILL_GREY) <= C.FILL_TOLERANCE


def render_verdict(samples: DataFrame, peers: DataFrame, allowed: DataFrame) -> DataFrame:
    """TRUNCATED, FEATURELESS or UNJUDGED samples (name, samples); allow-listed names are skipped.

    Samples are numbers or arrays of channels; ``sd`` is that of the channel that varies most.
    ``peers`` holds (name, peer_sd) of an independent decode, ``allowed`` a list of names.
    """
    several = isinstance(samples.schema["samples"].dataType.elementType, T.ArrayType)
    spread, fill = (channel_sd, is_fill) if several else (sample_sd, is_fill_value)
    judged = (
        samples.join(allowed.select("name"), "name", "left_anti")
        .join(peers.select("name", "peer_sd"), "name", "left")
        .withColumns({
            "tail": trailing_flat(F.col("samples")),
            "sd": spread(F.col("samples")),
        })
    )
    flat = F.col("sd") < C.FLAT_SD
    verdict = (
        F.when((F.col("tail") >= C.MIN_TAIL) & fill(F.col("samples")), "TRUNCATED")
        .when(flat & F.col("peer_sd").isNull(), "UNJUDGED")
        .when(flat & (F.col("peer_sd") > C.DETAILED_SD), "FEATURELESS")
    )
    return (
        judged.withColumn("verdict", verdict)
        .filter("verdict IS NOT NULL")
        .select("name", "verdict", "tail", "sd", "peer_sd")
    )
