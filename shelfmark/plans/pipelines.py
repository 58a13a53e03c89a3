"""Whole jobs made of several operators: backlog run, document view and performance gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from ..functions import html as H
from ..functions.encoding import decode_text
from ..functions.paths import content_kind, extension
from ..functions.text import find_all
from ..operators import gates, summaries
from ..sources.files import supported_only


def backlog_report(
    files: DataFrame, sizes: Sequence[int], stored: DataFrame, outcome: Column
) -> DataFrame:
    """Find, keep the supported, subtract what is stored, judge each file, and report.

    ``outcome`` is what the worker returned for a (file, size) that was not stored.
    """
    key = ["path", "length", "mtime", "size"]
    known = stored.select(*key).distinct().withColumn("_stored", F.lit(True))
    attempts = (
        gates.requested_sizes(supported_only(files, "path"), sizes)
        .join(known, key, "left")
        .withColumn("outcome", F.when(F.col("_stored"), "already").otherwise(outcome))
    )
    return summaries.run_report(gates.backlog_verdict(attempts), F.col("verdict"))


def view_documents(files: DataFrame, needle: str) -> DataFrame:
    """(path, content) to (path, kind, text, hits): routed, decoded, made readable and searched.

    Only rows routed to a text view are decoded; pictures and binaries keep a NULL text.
    """
    routed = files.withColumn("kind", content_kind(F.col("path"), F.lit(False), F.col("content")))
    shown = F.col("kind").isin("Markdown", "Text")
    decoded = routed.withColumn("text", decode_text(F.when(shown, F.col("content"))))
    is_html = extension(F.col("path")).isin("html", "htm")
    readable = decoded.withColumn("text", F.when(is_html, H.html_text(F.col("text"))).otherwise(F.col("text")))
    return readable.select(
        "path", "kind", "text", F.when(F.col("text").isNotNull(), find_all(F.col("text"), F.lit(needle))).alias("hits")
    )


def performance_gate(
    runs: DataFrame, recorded: DataFrame, allowed: DataFrame, again: DataFrame, drift: DataFrame
) -> DataFrame:
    """Suspects of both gates with their verdict: confirmed, cleared or inconclusive.

    ``runs`` holds (name, ext, ms, peer_ms) best times, ``recorded`` the own baseline, ``again``
    the confirming measurement (name, ms, peer_ms), ``drift`` one row with the run's drift.
    """
    peer = gates.peer_gate(runs, allowed).select(
        F.lit("peer").alias("gate"), "name", "ms", F.col("peer_ms").alias("reference"), "max_ratio"
    )
    own = gates.self_gate(runs.select("name", "ms"), recorded).filter("verdict = 'suspect'").select(
        F.lit("self").alias("gate"), "name", "ms", F.col("was").alias("reference"),
        F.lit(C.SELF_MAX_RATIO).alias("max_ratio"),
    )
    retried = again.select("name", F.col("ms").alias("_ms"), F.col("peer_ms").alias("_peer"))
    suspects = peer.unionByName(own).join(retried, "name", "left")
    now = F.coalesce("_ms", "ms")
    reference = F.when(F.col("gate") == "peer", F.coalesce("_peer", "reference")).otherwise(F.col("reference"))
    ratio = gates.round2(now / reference)
    holds = (ratio > F.col("max_ratio")) & (now - reference >= C.SELF_MIN_DELTA_MS)
    moved = drift.select(F.max("drift")).scalar()
    return suspects.select(
        "gate", "name", ratio.alias("ratio"), "max_ratio",
        F.when(moved > C.MAX_DRIFT, "inconclusive").when(holds, "confirmed").otherwise("cleared").alias("verdict"),
    )
