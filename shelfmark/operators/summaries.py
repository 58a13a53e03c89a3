"""Reports: counts, outcomes, best-of-N, percentiles and drift."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from .gates import peer_ratio
from .ordering import rank_values

PERCENTILES = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def run_report(outcomes: DataFrame, outcome: Column, keys: Sequence[str] = ()) -> DataFrame:
    """found = built + already + partial + failed; skipped files are counted apart."""
    names = ("built", "already", "partial", "failed")
    return outcomes.groupBy(*keys).agg(
        F.count_if(outcome.isin(*names)).alias("found"),
        *[F.count_if(outcome == n).alias(n) for n in names],
        F.count_if(outcome == "skipped").alias("skipped"),
    )


def batch_outcome(
    results: DataFrame, ok: Column, reason: Column, ord_: Column, keys: Sequence[str] = ()
) -> DataFrame:
    """done of total, and the first failure's reason; nothing done is an error."""
    return (
        results.groupBy(*keys)
        .agg(
            F.count_if(ok).alias("done"),
            F.count("*").alias("total"),
            F.min_by(F.when(~ok, reason), F.when(~ok, ord_)).alias("first_failure"),
        )
        .withColumn("is_error", F.col("done") == 0)
    )


def archive_totals(entries: DataFrame, archive: str = "archive_id") -> DataFrame:
    """Files (folders excluded) and total bytes per archive."""
    return entries.groupBy(archive).agg(
        F.count_if(~F.col("is_dir")).alias("files"), F.sum("size").alias("total_bytes")
    )


def category_rollup(df: DataFrame, category: str) -> DataFrame:
    """Count per category and in total (NULL category marks the total row)."""
    return (
        df.rollup(category)
        .agg(F.count("*").alias("n"), F.grouping(category).alias("_g"))
        .select(
            F.when(F.col("_g") == 0, F.col(category)).alias(category),
            (F.col("_g") == 1).alias("is_total"), "n",
        )
    )


def categories_consistent(claimed: DataFrame, df: DataFrame, category: str) -> DataFrame:
    """Claimed counts (category, n) against the live ones; rows that differ."""
    live = df.groupBy(category).agg(F.count("*").alias("live"))
    return (
        claimed.join(live, category, "full_outer")
        .filter(~F.col("n").eqNullSafe(F.col("live")))
        .select(category, F.col("n").alias("claimed"), "live")
    )


def best_of_n(runs: DataFrame) -> DataFrame:
    """Fastest successful repeat per name; a name with no success stays as FAIL."""
    return (
        runs.groupBy("name")
        .agg(F.min("ms").alias("ms"), F.count("*").alias("attempts"))
        .withColumn("status", F.when(F.col("ms").isNull(), "FAIL").otherwise("ok"))
    )


def latency_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, ok: Column | None = None
) -> DataFrame:
    """Nearest-rank percentiles over every row, and how many rows failed."""
    ranks = {
        name: F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1)) for name, p in PERCENTILES.items()
    }
    out = rank_values(df, keys, value, ranks)
    if ok is None:
        return out
    # A group without a single value is a row too: its failures count.
    failed = df.groupBy(*keys).agg(F.count_if(~ok).alias("failed"))
    if not keys:
        return out.withColumn("failed", failed.scalar())
    own = out.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "n", *ranks)
    match = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return failed.join(own, match, "left").select(
        *keys, F.coalesce("n", F.lit(0)).alias("n"), *ranks, "failed"
    )


def true_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Middle value, or the mean of the two middle values."""
    ranks = {"_lo": F.floor((F.col("n") + 1) / 2), "_hi": F.floor(F.col("n") / 2) + 1}
    return rank_values(df, keys, value, ranks).select(
        *keys, "n", ((F.col("_lo") + F.col("_hi")) / 2).alias("median")
    )


def speed_summary(rows: DataFrame) -> DataFrame:
    """Header of a speed report over (ext, ms, peer_ms): counts and the median ratio."""
    rated = rows.withColumn("ratio", peer_ratio(F.col("ms"), F.col("peer_ms")))
    median = true_median(rated, [], "ratio").select("median")
    return rated.agg(
        F.count("*").alias("samples"),
        F.count_distinct("ext").alias("formats"),
        F.count("ratio").alias("with_peer"),
        F.count_if(F.col("ratio") <= 1.0).alias("as_fast"),
        F.count_if(F.col("ratio").isNull()).alias("no_peer"),
    ).withColumn("median_ratio", median.scalar())


def drift(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Spread of reference timings: (max - min) / max."""
    return (
        df.groupBy(*keys)
        .agg(F.max(value).alias("hi"), F.min(value).alias("lo"))
        .withColumn(
            "drift", F.when(F.col("hi") > 0, (F.col("hi") - F.col("lo")) / F.col("hi")).otherwise(0.0)
        )
    )


def worst_drift(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Largest relative move between two readings of the same references."""
    a, b = F.col("_a"), F.col("_b")
    moved = before.select(key, F.col(value).alias("_a")).join(
        after.select(key, F.col(value).alias("_b")), key
    )
    move = F.when((a != 0) & (b != 0), F.abs(b - a) / F.greatest(a, b))
    return moved.agg(F.coalesce(F.max(move), F.lit(0.0)).alias("worst_drift"))


def passes_by_ext(results: DataFrame, ext: str, ok: Column) -> DataFrame:
    """An extension passes when any sample does; it fails only if none does."""
    return results.groupBy(ext).agg(F.bool_or(ok).alias("passes"), F.count_if(ok).alias("ok_samples"))


def object_counts(objects: DataFrame, kind: Column, names: Mapping[str, str]) -> DataFrame:
    """One row of counts, one column per kind of object."""
    return objects.agg(*[F.count_if(F.lower(kind) == k).alias(out) for k, out in names.items()])


def log_calls(lines: DataFrame, text: Column, pattern: str) -> DataFrame:
    """Number captured by a pattern in matching lines, with its count."""
    return (
        lines.filter(text.rlike(pattern))
        .groupBy(F.regexp_extract(text, pattern, 1).cast("bigint").alias("value"))
        .agg(F.count("*").alias("calls"))
    )


# A three-digit claim before a noun; '300+' is deliberately vague and exempt.  Fixed pattern.
CLAIM = (
    r"(?i)\b(\d{3})(?!\+)\b(?:[^\r\n.]{0,30}?)\s(?:formats?|file types?|extensions?)\b"
)


def stale_counts(docs: DataFrame, key: str, text: str, actual: int | Column) -> DataFrame:
    """Claims of a count in prose that differ from the real one."""
    claims = F.explode(F.regexp_extract_all(text, F.lit(CLAIM), F.lit(1)))
    actual = F.lit(actual) if isinstance(actual, int) else actual
    return (
        docs.select(key, claims.alias("_claim"))
        .select(key, F.col("_claim").cast("int").alias("claimed"))
        .filter(F.col("claimed") != actual)
        .groupBy(key, "claimed")
        .agg(F.count("*").alias("mentions"))
    )


def picture_rank(picture_type: Column) -> Column:
    """Front cover first, unlabelled next, anything else, file icons last."""
    return (
        F.when(picture_type == 3, 0).when(picture_type == 0, 1)
        .when(picture_type.isin(1, 2), 3).otherwise(2)
    )


def best_picture(pictures: DataFrame, file: str = "file_id") -> DataFrame:
    """Best picture per file over (ord, picture_type, size): rank, then size, then the earlier."""
    order = F.struct(
        picture_rank(F.col("picture_type")).alias("rank"), (-F.col("size")).alias("size"), F.col("ord")
    )
    best = F.min_by(F.struct("ord", "picture_type", "size"), order)
    return pictures.groupBy(file).agg(best.alias("_b")).select(file, "_b.*")
