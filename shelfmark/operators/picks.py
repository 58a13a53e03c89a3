"""Picks, plans and neighbours: what a serial walk would do in order, as windows that stay bounded."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as C
from ..functions.paths import extension, file_name, folder, stem
from ..scratch import pin
from .ordering import cover_key, natural_key, ordered_neighbours, ordered_prefix


def cover_candidates(entries: DataFrame) -> DataFrame:
    """Cover-eligible archive entries with their class (lower is better).

    "Drop credit pages unless nothing is left, then drop last-resort formats unless nothing is
    left" keeps exactly the best class an archive has: clean before credit, native before exotic.
    """
    name = F.col("name")
    low = F.lower(name)
    ext = F.substring_index(low, ".", -1)
    last = F.substring_index(F.substring_index(low, "/", -1), "\\", -1)
    credit = reduce(or_, [F.contains(last, F.lit(w)) for w in C.CREDIT_WORDS])
    # A thumbs.db is no image name, so the image test already drops it.
    return entries.filter(
        ~F.col("is_dir")
        & F.col("size").between(1, C.MAX_COVER_BYTES)
        & ext.isin(*C.COVER_IMAGE_EXTS)
        & ~F.contains(name, F.lit("__MACOSX"))
    ).withColumns({
        "_class": credit.cast("int") * 2 + ext.isin(*C.LAST_RESORT_COVER_EXTS).cast("int"),
        "_cover": F.contains(last, F.lit("cover")),
    })


def pick_covers(
    entries: DataFrame, want: int, archive: str = "archive_id", *, prefer_cover: bool = True
) -> DataFrame:
    """Best ``want`` entries per archive, ranked from 1.

    Entries are (archive, ord, name, is_dir, size).  The rank filter is cut per input partition
    before the shuffle, so a hot archive sends at most ``want`` rows per task.
    """
    leads = F.col("_cover").desc() if prefer_cover else F.lit(0)
    best = Window.partitionBy(archive).orderBy(
        "_class", leads, cover_key(F.col("name")), F.col("ord")
    )
    top = cover_candidates(entries).withColumn("rank", F.row_number().over(best)).filter(
        F.col("rank") <= want
    )
    return (
        top.withColumn("_best", F.min("_class").over(Window.partitionBy(archive)))
        .filter("_class = _best")
        .drop("_class", "_cover", "_best")
    )


def budgeted_pick(
    picks: DataFrame, want: int, archive: str = "archive_id", budget: int = C.COVER_SHEET_BUDGET
) -> DataFrame:
    """Walk at most ``want`` ranked picks, skipping one that no longer fits the budget.

    A skipped pick costs nothing and later, smaller ones may still fit, so this folds the (at
    most ``want``) picks of each archive instead of taking a running sum.
    """
    limit = budget if want > 1 else 2**62
    ranked = picks.filter(F.col("rank") <= want).groupBy(archive).agg(
        F.array_sort(F.collect_list(F.struct("rank", "ord", "name", "size"))).alias("_picks")
    )
    seed = F.struct(
        F.lit(limit).cast("bigint").alias("left"), F.array().cast("array<int>").alias("kept")
    )

    def step(acc: Column, pick: Column) -> Column:
        cost = F.least(pick["size"], F.lit(C.MAX_COVER_BYTES)).cast("bigint")
        fits = cost <= acc["left"]
        return F.struct(
            F.when(fits, acc["left"] - cost).otherwise(acc["left"]).alias("left"),
            F.when(fits, F.concat(acc["kept"], F.array(pick["rank"]))).otherwise(acc["kept"]).alias("kept"),
        )

    kept = F.aggregate("_picks", seed, step)["kept"]
    return (
        ranked.select(archive, F.explode(F.filter("_picks", lambda p: F.array_contains(kept, p["rank"]))).alias("p"))
        .select(archive, "p.*")
    )


def dedupe_by_name(picks: DataFrame, archive: str = "archive_id") -> DataFrame:
    """First pick per (archive, name), by rank."""
    rest = [c for c in picks.columns if c not in (archive, "name")]
    first = F.min_by(F.struct(*rest), F.col("rank")).alias("_p")
    return picks.groupBy(archive, "name").agg(first).select(archive, "name", "_p.*")


def retain_recent(
    puts: DataFrame,
    cache: str,
    *,
    max_bytes: int = C.CACHE_MAX_BYTES,
    max_entries: int = C.CACHE_MAX_ENTRIES,
) -> DataFrame:
    """What a bounded most-recent cache keeps: puts are (cache, key, at, size, is_full).

    Per key a full-quality entry beats any scaled one, then the latest wins.  The running total
    counts entries already refused, so it is a plain cumulative sum over the newest entries.
    """
    newest = F.max_by(
        F.struct("at", "size", "is_full"), F.struct(F.col("is_full"), F.col("at"))
    ).alias("_e")
    latest = puts.groupBy(cache, "key").agg(newest).select(cache, "key", "_e.*")
    order = Window.partitionBy(cache).orderBy(F.col("at").desc(), "key")
    top = latest.withColumn("position", F.row_number().over(order)).filter(
        F.col("position") <= max_entries
    )
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return top.withColumn("running_bytes", F.sum("size").over(running)).filter(
        F.col("running_bytes") <= max_bytes
    )


def latest_generation(results: DataFrame, key: str, generation: str) -> DataFrame:
    """Results of the newest request per key; older generations are abandoned."""
    live = results.groupBy(key).agg(F.max(generation).alias("_live"))
    return results.join(live, key).filter(F.col(generation) == F.col("_live")).drop("_live")


# --- rename plans -------------------------------------------------------------------------

def _join_name(base: Column, number: Column | None, ext: Column) -> Column:
    name = base if number is None else F.concat(base, F.lit(" ("), number.cast("string"), F.lit(")"))
    return F.when(ext != "", F.concat(name, F.lit("."), ext)).otherwise(name)


def rename_plan(
    requests: DataFrame,
    existing: DataFrame | None = None,
    *,
    first_suffix: int = 2,
) -> DataFrame:
    """Collision-free destination per request.

    ``requests`` holds (ord, path, folder, base): move each path into ``folder`` as ``base`` plus
    its own extension.  ``existing`` lists taken paths.  Names are claimed in ``ord`` order; the
    plain name first, then `` (n)`` from ``first_suffix`` (2 for moves, 1 for batch outputs).
    A request whose plain name is its own path is already in place.
    """
    # Names are worked out once; every later pass reads them.
    asked = pin(_asked(requests), "requests")
    plan = _claim(asked, existing, first_suffix)
    if asked.filter(F.col("base").rlike(r" \(\d+\)$")).isEmpty():
        return plan.drop("_slot")
    # A base that itself looks numbered can meet another base's suffix.  The earlier claim stays;
    # the later one, and whoever stands behind it for the same name, claims again with every
    # settled name taken.
    settled = None
    while True:
        plan = pin(plan, "claims")
        winner = plan.groupBy(F.lower("destination").alias("_to")).agg(F.min("ord").alias("_first"))
        beaten = plan.join(winner, F.lower("destination") == F.col("_to")).filter("ord <> _first")
        if beaten.isEmpty():
            done = plan if settled is None else settled.unionByName(plan)
            return done.drop("_slot")
        redo = beaten.groupBy("_slot").agg(F.min("ord").alias("_from"))
        marked = plan.join(redo, "_slot", "left")
        kept = marked.filter("_from IS NULL OR ord < _from").drop("_from")
        settled = kept if settled is None else settled.unionByName(kept)
        again = marked.filter("ord >= _from").select("ord")
        names = settled.select(F.col("destination").alias("path"))
        taken = names if existing is None else existing.select("path").unionByName(names)
        plan = _claim(asked.join(again, "ord", "left_semi"), taken, first_suffix)


def _asked(requests: DataFrame) -> DataFrame:
    """The requests with their extension, name slot, and whether they are in place."""
    ext = F.regexp_extract(file_name(F.col("path")), r"^.+\.([^.]*)$", 1)
    plain = F.concat(F.col("folder"), F.lit("/"), _join_name(F.col("base"), None, F.col("ext")))
    return requests.withColumns({"ext": ext}).withColumns({
        "_slot": F.lower(plain),
        "in_place": F.lower(plain) == F.lower("path"),
    })


def _claim(
    asked: DataFrame, existing: DataFrame | None, first_suffix: int
) -> DataFrame:
    """One round of claims, name slot by name slot."""
    todo = asked.filter(~F.col("in_place"))
    taken = _taken_slots(asked, existing, first_suffix)
    # Ranks among the requests of one slot, then the taken numbers that push them up.
    ranked = ordered_prefix(todo, ["_slot"], [F.col("ord")], number="_at").withColumn(
        "_hole", F.lit(0)
    )
    holes = ordered_prefix(taken, ["_slot"], [F.col("_taken")], number="_nth").select(
        "_slot", (F.col("_taken") - F.col("_nth") + 1).alias("_at"), F.lit(1).alias("_hole")
    )
    # A hole at or before a rank shifts it by one.
    numbered = (
        ordered_prefix(
            ranked.unionByName(holes, allowMissingColumns=True), ["_slot"],
            [F.col("_at"), F.col("_hole").desc(), F.col("ord")],
            number="_seq", sums={"_shift": F.col("_hole")},
        )
        .filter("_hole = 0")
        .withColumn("_number", F.col("_at") + F.col("_shift"))
    )
    suffix = F.when(F.col("_number") > 1, F.col("_number") - 2 + first_suffix)
    target = F.when(suffix.isNull(), _join_name(F.col("base"), None, F.col("ext"))).otherwise(
        _join_name(F.col("base"), suffix, F.col("ext"))
    )
    done = numbered.select(
        "ord", "path", F.concat(F.col("folder"), F.lit("/"), target).alias("destination"),
        F.lit("rename").alias("action"), "_slot",
    )
    stay = asked.filter("in_place").select(
        "ord", "path", F.col("path").alias("destination"), F.lit("in_place").alias("action"), "_slot"
    )
    return done.unionByName(stay)


def _taken_slots(asked: DataFrame, existing: DataFrame | None, first_suffix: int) -> DataFrame:
    """(slot, 1-based number in the slot's naming sequence) that are not free."""
    own = asked.filter("in_place").select(F.col("path"))
    paths = own if existing is None else own.unionByName(existing.select("path"))
    low = F.lower("path")
    numbered = F.regexp_extract(low, r"^(.*) \(([1-9]\d{0,17})\)(\.[^./\\]*)?$", 2)
    base = F.concat(
        F.regexp_extract(low, r"^(.*) \(([1-9]\d{0,17})\)(\.[^./\\]*)?$", 1),
        F.regexp_extract(low, r"^(.*) \(([1-9]\d{0,17})\)(\.[^./\\]*)?$", 3),
    )
    position = numbered.try_cast("bigint") - first_suffix + 2
    slots = F.array(
        F.struct(low.alias("_slot"), F.lit(1).cast("bigint").alias("_taken")),
        F.struct(F.when(position >= 2, base).alias("_slot"), position.alias("_taken")),
    )
    return (
        paths.select(F.explode(slots).alias("_s")).select("_s.*").filter("_slot IS NOT NULL").distinct()
    )


def batch_output_plan(inputs: DataFrame, ext: str, out_dir: str | None = None, **options) -> DataFrame:
    """Output name per input of a batch: same stem, new extension, collisions count from (1)."""
    path = F.col("path")
    where = F.lit(out_dir) if out_dir is not None else folder(path)
    requests = inputs.select(
        "ord", F.concat(path, F.lit("."), F.lit(ext)).alias("path"), where.alias("folder"),
        stem(path).alias("base"),
    )
    return rename_plan(requests, first_suffix=1, **options).select(
        "ord", F.regexp_replace("path", rf"\.{ext}$", "").alias("path"), "destination"
    )


def neighbours(
    files: DataFrame, folder_col: str, path: str
) -> DataFrame:
    """Previous, next and two files ahead in natural order, wrapping at both ends.

    A folder holding most of the files is cut into slices; only their border rows are exchanged.
    """
    keyed = files.select(
        F.col(folder_col).alias("folder"), F.col(path).alias("path"),
        natural_key(file_name(F.col(path))).alias("_k"),
    )
    return ordered_neighbours(
        keyed, ["folder"], [F.col("_k"), F.col("path")], "path",
        {"next_path": 1, "ahead_2": 2, "ahead_3": 3, "previous_path": -1}, number="position",
    ).select("folder", "position", "n", "path", "next_path", "ahead_2", "ahead_3", "previous_path")


def numbered_rows(
    df: DataFrame, order: Sequence[Column], number: str = "row_no"
) -> DataFrame:
    """1-based data row numbers over a whole table."""
    keyed = df.withColumn("_all", F.lit(0))
    return ordered_prefix(keyed, ["_all"], order, number=number).drop("_all")


def routed(plan: DataFrame) -> DataFrame:
    """done and skipped counts of a routing plan (a NULL destination is a skip)."""
    return plan.agg(
        F.count("destination").alias("done"), F.count_if(F.col("destination").isNull()).alias("skipped")
    )


__all__ = [
    "batch_output_plan", "budgeted_pick", "cover_candidates", "dedupe_by_name", "extension",
    "latest_generation", "neighbours", "numbered_rows", "pick_covers", "rename_plan",
    "retain_recent", "routed",
]
