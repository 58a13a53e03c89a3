"""Quality rules: text statistics, and outliers by the minimum covariance determinant of each group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrays import let
from ..scratch import pin
from .common import BLANKS, WORD_GAP

SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 5

# The base rule: fewer words than this, or more than this percentage of them in repeated windows.
LEAST_WORDS = 10
MOST_REPEATED = 20

# The half (here three quarters) of a group whose covariance has the least determinant is looked
# for in this many concentration steps.
PART, STEPS = 0.75, 6
# Groups of fewer rows are pooled by language, then all together; fewer still have no verdict.
LEAST_ROWS = 50

# Statistics of the vector, and the spread that each has at least, so that a group in which
# nearly all rows have no symbols, say, does not reject a row for having one.
FLOORS = {"length": 0.08, "symbols": 0.3, "lines": 0.45, "repeats": 0.3}

# Fixed values for four statistics: the covariance of the central 75 % of a normal sample times
# the first is that of the whole; squared distances above the second have a chance of 0.0001.
CONSISTENCY, CUTOFF = 1.485, 23.513

# Cells of the histograms from which medians and distance ranks are read.
_CELL = 0.01
_BROADCAST_GROUPS = 100_000


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    none = F.array().cast("array<string>")
    return F.when(trimmed == "", none).otherwise(F.split(trimmed, WORD_GAP))


def _without(text: Column, signs: str) -> Column:
    return F.length(F.translate(text, signs, ""))


def _repeated_words(hashes: Column) -> Column:
    """Words in windows that occur twice or more, from the hash of the window at each word."""
    placed = F.array_sort(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))

    def twice(rows: Column) -> Column:
        def place(row: Column, n: Column) -> Column:
            again = (F.get(rows, n - 1).h == row.h) | (F.get(rows, n + 1).h == row.h)
            return F.when(again, row.k)

        return F.array_sort(F.filter(F.transform(rows, place), lambda k: k.isNotNull()))

    def covered(so_far: Column, k: Column) -> Column:
        fresh = F.least(F.lit(WINDOW_WORDS), k + WINDOW_WORDS - so_far.end)
        return F.struct((k + WINDOW_WORDS).alias("end"), (so_far.n + fresh).alias("n"))

    begin = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    counted = F.aggregate(let(placed, twice), begin, covered, lambda at: at.n)
    # Most texts repeat nothing, which is cheap to see.
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), counted).otherwise(0)


def text_statistics(docs: DataFrame, *carried: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the ``carried`` columns, and the counts of each whole text; a null text has none.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_lines`` (with a word),
    ``n_dup_lines`` (equal to an earlier one) and ``n_repeat_words`` (in five-word windows found
    twice or more, the first time included), all bigint.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), *carried, content.alias("_text"))
    text_ = F.col("_text")
    lines = F.filter(F.split(text_, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    windows = F.when(
        F.size("_words") >= WINDOW_WORDS,
        F.transform(
            F.sequence(F.lit(0), F.size("_words") - WINDOW_WORDS),
            lambda k: F.xxhash64(*[F.get("_words", k + n) for n in range(WINDOW_WORDS)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    counted = rows.withColumns({"_words": _words(text_), "_lines": lines}).withColumn("_windows", windows)
    return counted.select(
        "doc_id",
        *carried,
        F.size("_words").cast("long").alias("n_words"),
        _without(text_, BLANKS).cast("long").alias("word_chars"),
        (F.length(text_) - _without(text_, SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("_windows")).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def vector() -> dict[str, Column]:
    """The transformed statistics: logarithms of the mean word length and of three shares."""
    n = F.col("n_words")
    return {
        # A few words of middling length are added, so that short texts scatter less.
        "length": F.log((F.col("word_chars") + 120) / (n + 20)),
        "symbols": F.log1p(100 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "lines": F.log1p(10 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "repeats": F.log1p(10 * F.col("n_repeat_words") / F.greatest(n, F.lit(1))),
    }


def _pooled(rows: DataFrame, usable: Column, lang: str, source: str) -> DataFrame:
    """Add ``cell``, the group that judges a row: its language and source, or a pool of small ones.

    Null languages and sources are values like others.
    """
    def name(*columns: str) -> Column:
        marks = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
        return F.xxhash64(F.lit(len(columns)), *marks)

    sizes = rows.filter(usable).groupBy(lang, source).agg(F.count("*").alias("n"))
    enough = F.col("n") >= LEAST_ROWS
    own = sizes.withColumn("cell", F.when(enough, name(lang, source)))
    small = F.sum(F.when(F.col("cell").isNull(), F.col("n"))).over(Window.partitionBy(lang))
    own = own.withColumn("cell", F.when(F.col("cell").isNotNull(), F.col("cell"))
                         .when(small >= LEAST_ROWS, name(lang)).otherwise(F.xxhash64(F.lit(0))))
    cells = own.select(F.col(lang).alias("_lang"), F.col(source).alias("_source"), "cell")
    match = F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source"))
    return rows.join(_near(cells), match, "left").drop("_lang", "_source")


def _near(groups: DataFrame) -> DataFrame:
    """A table of one row a group: to every executor if it is small, else left to a shuffled join."""
    kept = pin(groups, "groups")
    return F.broadcast(kept) if kept.limit(_BROADCAST_GROUPS + 1).count() <= _BROADCAST_GROUPS else kept


def _cell_rank(rows: DataFrame, value: Column, part: float) -> DataFrame:
    """``cell, edge``: the histogram cell up to which lie ``part`` of each group's values."""
    cells = rows.groupBy("cell", F.floor(value / _CELL).cast("long").alias("edge")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("cell").orderBy("edge").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy("cell"))})
    return ranked.filter(F.col("upto") >= F.ceil(part * F.col("all"))).groupBy("cell").agg(F.min("edge").alias("edge"))


def _factor(moments: DataFrame, names: list[str], scale: float) -> DataFrame:
    """Mean and Cholesky factor of each group's scaled covariance with the floors added."""
    out = moments
    for k, a in enumerate(names):
        for b in names[: k + 1]:
            own = F.col(f"s_{a}_{b}") / F.col("n") - F.col(f"m_{a}") * F.col(f"m_{b}")
            floor = FLOORS[a] ** 2 if a == b else 0.0
            out = out.withColumn(f"c_{a}_{b}", own * scale + floor)
    for k, a in enumerate(names):
        for j, b in enumerate(names[: k + 1]):
            rest = reduce(lambda x, c: x - F.col(f"l_{a}_{c}") * F.col(f"l_{b}_{c}"), names[:j], F.col(f"c_{a}_{b}"))
            out = out.withColumn(f"l_{a}_{b}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if a == b else rest / F.col(f"l_{b}_{b}"))
    keep = [f"m_{a}" for a in names] + [f"l_{a}_{b}" for k, a in enumerate(names) for b in names[: k + 1]]
    return out.select("cell", *keep)


def _with_distance(rows: DataFrame, factors: DataFrame, names: list[str]) -> DataFrame:
    """Add ``d2``, the squared Mahalanobis distance by forward substitution (null without a group)."""
    out = rows.join(factors.withColumnRenamed("cell", "_cell"), F.col("cell") == F.col("_cell"), "left")
    for k, a in enumerate(names):
        left = reduce(lambda x, b: x - F.col(f"l_{a}_{b}") * F.col(f"y_{b}"), names[:k], F.col(a) - F.col(f"m_{a}"))
        out = out.withColumn(f"y_{a}", left / F.col(f"l_{a}_{a}"))
    return out.withColumn("d2", sum(F.pow(f"y_{a}", 2) for a in names)).select(*rows.columns, "d2")


def _moments(rows: DataFrame, names: list[str]) -> DataFrame:
    sums = [F.avg(a).alias(f"m_{a}") for a in names] + [
        F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for k, a in enumerate(names) for b in names[: k + 1]
    ]
    return rows.groupBy("cell").agg(F.count("*").alias("n"), *sums)


def _start(rows: DataFrame, names: list[str]) -> DataFrame:
    """A robust start for every group: medians, and spreads from the median absolute deviation."""
    def centre(column: Column, name: str) -> DataFrame:
        middle = ((F.col("edge") + 0.5) * _CELL).alias(name)
        return _cell_rank(rows, column, 0.5).select("cell", middle)

    mids = reduce(lambda x, y: x.join(y, "cell"), [centre(F.col(a), f"m_{a}") for a in names])
    mids = _near(mids)
    apart = rows.join(mids, "cell").withColumns({f"d_{a}": F.abs(F.col(a) - F.col(f"m_{a}")) for a in names})

    def spread(a: str) -> DataFrame:
        scale = F.greatest((F.col("edge") + 0.5) * _CELL * 1.4826, F.lit(FLOORS[a]))
        return _cell_rank(apart, F.col(f"d_{a}"), 0.5).select("cell", scale.alias(f"l_{a}_{a}"))

    out = reduce(lambda x, y: x.join(y, "cell"), [mids, *[spread(a) for a in names]])
    zeros = {f"l_{a}_{b}": F.lit(0.0) for k, a in enumerate(names) for b in names[:k]}
    return out.withColumns(zeros)


def robust_factors(rows: DataFrame, names: list[str]) -> DataFrame:
    """Robust mean and covariance factor of each ``cell``, one row each.

    From a start at medians, each concentration step takes the ``PART`` of a group's rows that lie
    nearest (all rows of the last histogram cell that is needed, so that ties stay together) and
    estimates anew; the determinant never grows.  Each step reads the rows twice and brings
    together one histogram and one set of sums a group.
    """
    factors = _near(_start(rows, names))
    for step in range(STEPS):
        near = _with_distance(rows, factors, names)
        closeness = F.log1p("d2")
        cut = _near(_cell_rank(near, closeness, PART).withColumnRenamed("cell", "_cell"))
        inner = near.join(cut, F.col("cell") == F.col("_cell")).filter(F.floor(closeness / _CELL) <= F.col("edge"))
        scale = CONSISTENCY if step == STEPS - 1 else 1.0
        factors = _near(_factor(_moments(inner, names), names, scale))
    return factors


def judge(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """Statistics and verdict of every row: ``base_failed``, ``distance``, ``kept`` behind the counts.

    ``kept`` is false where the base rule fails or where the squared robust distance from the
    row's language and source exceeds ``CUTOFF``.  Rows that fail the base rule take no part in
    the estimates and have no distance; nor have rows of a pool of fewer than ``LEAST_ROWS``,
    which are kept.  Rows that repeat count as often as they occur.
    """
    named = docs.select(
        F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source")
    )
    counts = text_statistics(named, "lang", "source").withColumn("base_failed", base_failed())
    rows = pin(counts.withColumns(vector()), "statistics")
    usable = ~F.col("base_failed")
    celled = _pooled(rows, usable, "lang", "source")
    names = list(FLOORS)
    inside = pin(celled.filter(usable & F.col("cell").isNotNull()), "celled")
    large = inside.groupBy("cell").agg(F.count("*").alias("_n")).filter(F.col("_n") >= LEAST_ROWS)
    inside = inside.join(_near(large.select("cell")), "cell", "left_semi")
    factors = robust_factors(inside, names)
    judged = _with_distance(celled, factors, names)
    distance = F.when(usable, F.col("d2"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        distance.alias("distance"),
        (usable & F.coalesce(distance <= CUTOFF, F.lit(True))).alias("kept"),
    )
