"""Release gates: new results against recorded ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from .vectors import mean_abs_delta


def round2(value: Column) -> Column:
    """Two decimals, half to even on the binary value."""
    return F.rint(value * 100) / 100


def regression_diff(
    baseline: DataFrame, present: DataFrame, passing: DataFrame, key: str
) -> DataFrame:
    """Keys that regressed, went missing, or newly pass.

    The three sets are tagged, united and folded per key: one shuffle, and repeated keys
    collapse before it.
    """
    flags = ("in_baseline", "in_present", "in_passing")
    tagged = [
        df.select(key, *[F.lit(f == own).alias(f) for f in flags])
        for df, own in zip((baseline, present, passing), flags)
    ]
    folded = (
        tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
        .groupBy(key)
        .agg(*[F.bool_or(f).alias(f) for f in flags])
    )
    status = (
        F.when(F.col("in_baseline") & F.col("in_present") & ~F.col("in_passing"), "regressed")
        .when(F.col("in_baseline") & ~F.col("in_present"), "missing")
        .when(~F.col("in_baseline") & F.col("in_passing"), "new")
    )
    return folded.withColumn("status", status).filter("status IS NOT NULL").select(key, "status")


def self_gate(rows: DataFrame, recorded: DataFrame, exempt: Column | None = None) -> DataFrame:
    """Each measurement (name, ms) against its own recorded time: suspects and unseen names.

    Rows that are ``exempt`` (made in several sizes, say, and held against their peers) are skipped.
    """
    if exempt is not None:
        rows = rows.filter(~F.coalesce(exempt, F.lit(False)))
    was = F.greatest(F.col("_was"), F.lit(0.001))
    ratio = round2(F.col("ms") / was)
    joined = rows.join(recorded.select("name", F.col("ms").alias("_was")), "name", "left")
    suspect = (
        (F.col("ms") >= C.SELF_MIN_MS)
        & (F.col("ms") - was >= C.SELF_MIN_DELTA_MS)
        & (ratio > C.SELF_MAX_RATIO)
    )
    verdict = F.when(F.col("_was").isNull(), "unseen").when(suspect, "suspect")
    return (
        joined.withColumn("verdict", verdict)
        .filter("verdict IS NOT NULL")
        .select(
            "name", "ms", F.when(F.col("_was").isNotNull(), was).alias("was"),
            F.when(F.col("_was").isNotNull(), ratio).alias("ratio"), "verdict",
        )
    )


def peer_ratio(ms: Column, peer_ms: Column) -> Column:
    return F.when(peer_ms > 0, round2(ms / peer_ms))


def peer_gate(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """Worst eligible ratio per extension that is over its allowed ratio.

    The floors come before the pick: an exempt sample must not shadow one that is not.
    """
    ratio = peer_ratio(F.col("ms"), F.col("peer_ms"))
    eligible = rows.withColumn("ratio", ratio).filter(
        F.col("ratio").isNotNull()
        & (F.col("ms") >= C.SELF_MIN_MS)
        & (F.col("ms") - F.col("peer_ms") >= C.SELF_MIN_DELTA_MS)
    )
    worst = eligible.groupBy("ext").agg(
        F.min_by(
            F.struct("name", "ms", "peer_ms", "ratio"),
            F.struct((-F.col("ratio")).alias("r"), F.col("name")),
        ).alias("_w")
    )
    limit = F.coalesce(F.col("max_ratio"), F.lit(C.PEER_MAX_RATIO))
    return (
        worst.join(allowed.select("ext", "max_ratio"), "ext", "left")
        .filter(F.col("_w.ratio") > limit)
        .select("ext", "_w.name", "_w.ms", "_w.peer_ms", "_w.ratio", limit.alias("max_ratio"))
    )


def build_compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two result sets (name, ok, samples) by name: LOST, GAINED, CHANGED, SAME or ERROR."""
    a = old.select("name", F.col("ok").alias("_a"), F.col("samples").alias("_sa"))
    b = new.select("name", F.col("ok").alias("_b"), F.col("samples").alias("_sb"))
    joined = a.join(b, "name", "full_outer").withColumns({
        "_a": F.coalesce("_a", F.lit(False)), "_b": F.coalesce("_b", F.lit(False)),
    })
    delta = F.when(
        F.col("_a") & F.col("_b") & (F.size("_sa") == F.size("_sb")),
        mean_abs_delta(F.col("_sa"), F.col("_sb")),
    )
    status = (
        F.when(F.col("_a") & ~F.col("_b"), "LOST")
        .when(~F.col("_a") & F.col("_b"), "GAINED")
        .when(~F.col("_a"), F.lit(None))
        .when(F.col("delta").isNull(), "ERROR")
        .when(F.col("delta") >= C.CHANGED_DELTA, "CHANGED")
        .otherwise("SAME")
    )
    return (
        joined.withColumn("delta", delta)
        .withColumn("status", status)
        .filter("status IS NOT NULL")
        .select("name", "status", "delta")
    )


def expected_values(expected: DataFrame, samples: DataFrame) -> DataFrame:
    """Known answers (name, want) against samples (name, got); no sample is a failure too."""
    close = F.forall(
        F.zip_with("want", F.slice("got", 1, F.size("want")), lambda w, g: F.abs(w - g)),
        lambda d: F.coalesce(d <= C.CHANNEL_TOLERANCE, F.lit(False)),
    )
    verdict = F.when(F.col("got").isNull(), "missing").when(close, "ok").otherwise("wrong")
    return expected.join(samples, "name", "left").select("name", "want", "got", verdict.alias("verdict"))


def key_parity(entries: DataFrame, canonical: str) -> DataFrame:
    """Per locale, the canonical one too: missing, extra and repeated keys, and placeholder mismatches.

    ``entries`` holds (locale, key, ord, value); the first value of a repeated key counts.
    """
    placeholders = lambda v: F.array_sort(
        F.regexp_extract_all(v, F.lit(r"(\{[a-z_]+\})"), F.lit(1))
    )
    first = entries.groupBy("locale", "key").agg(
        F.min_by("value", "ord").alias("value"), F.count("*").alias("n")
    )
    canon = first.filter(F.col("locale") == canonical).select(
        "key", F.col("value").alias("_canon"), F.lit(True).alias("_known")
    )
    n_canon = canon.agg(F.count("*")).scalar()
    known = F.coalesce(F.col("_known"), F.lit(False))
    return (
        first.join(canon, "key", "left")
        .groupBy("locale")
        .agg(
            F.count_if(known).alias("present"),
            F.count_if(~known).alias("extra"),
            F.count_if(F.col("n") > 1).alias("duplicates"),
            F.count_if(known & (placeholders(F.col("_canon")) != placeholders(F.col("value"))))
            .alias("placeholder_mismatches"),
        )
        .select(
            "locale", (n_canon - F.col("present")).alias("missing"), "extra", "duplicates",
            "placeholder_mismatches",
        )
    )


def missing_keys(entries: DataFrame, canonical: str, locale: str) -> DataFrame:
    """The keys of the canonical locale that one locale lacks, and its keys nobody reads."""
    mine = entries.filter(F.col("locale") == locale).select("key")
    base = entries.filter(F.col("locale") == canonical).select("key")
    missing = base.join(mine, "key", "left_anti").distinct().select("key", F.lit("missing").alias("status"))
    extra = mine.join(base, "key", "left_anti").distinct().select("key", F.lit("extra").alias("status"))
    return missing.unionByName(extra)


def file_record(df: DataFrame, path: str, content: Column) -> DataFrame:
    """(path, bytes, sha256) of each row's content."""
    return df.select(
        F.col(path).alias("path"),
        F.octet_length(content).cast("bigint").alias("bytes"),
        F.sha2(content, 256).alias("sha256"),
    )


def manifest_diff(
    expected: DataFrame, actual: DataFrame, fields: Sequence[str] = ("bytes", "sha256")
) -> DataFrame:
    """Paths whose records differ: missing, extra, or the first field that changed."""
    both = expected.select("path", F.lit(True).alias("_e"), *[F.col(f).alias(f"_e_{f}") for f in fields])
    other = actual.select("path", F.lit(True).alias("_a"), *[F.col(f).alias(f"_a_{f}") for f in fields])
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra")
    for f in fields:
        status = status.when(~F.col(f"_e_{f}").eqNullSafe(F.col(f"_a_{f}")), f"changed:{f}")
    return (
        both.join(other, "path", "full_outer")
        .withColumn("status", status)
        .filter("status IS NOT NULL")
        .select("path", "status")
    )


def requested_sizes(files: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """One row per file and bucket, largest bucket first in each file's list."""
    from ..functions.sizes import build_order, normalize_sizes

    wanted = build_order(normalize_sizes(F.array(*[F.lit(int(s)) for s in sizes])))
    return files.withColumn("size", F.explode(wanted))


def work_backlog(files: DataFrame, sizes: Sequence[int], stored: DataFrame) -> DataFrame:
    """Files (path, length, mtime) x sizes that no stored result covers yet."""
    return requested_sizes(files, sizes).join(
        stored, ["path", "length", "mtime", "size"], "left_anti"
    )


def backlog_verdict(attempts: DataFrame) -> DataFrame:
    """Verdict per path from per-size outcomes: built, already, partial or failed."""
    built, already, landed = F.col("_built"), F.col("_already"), F.col("_landed")
    return (
        attempts.groupBy("path")
        .agg(
            F.bool_or(F.col("outcome") == "built").alias("_built"),
            F.bool_or(F.col("outcome") == "already").alias("_already"),
            F.bool_and(F.col("outcome") != "failed").alias("_landed"),
        )
        .select(
            "path",
            F.when(~(built | already), "failed").when(~landed, "partial").when(built, "built")
            .otherwise("already").alias("verdict"),
        )
    )


def tier_coverage(tiered: DataFrame, real: DataFrame) -> DataFrame:
    """Tiered samples, then real ones only for extensions the tiers lack; name clashes go."""
    low = lambda df: df.select(F.lower("name").alias("_clash")).distinct()
    kept = tiered.withColumn("_clash", F.lower("name")).join(low(real), "_clash", "left_anti").drop("_clash")
    fill = real.join(tiered.select("ext").distinct(), "ext", "left_anti")
    return kept.withColumn("corpus", F.lit("tiered")).unionByName(
        fill.withColumn("corpus", F.lit("real"))
    )
