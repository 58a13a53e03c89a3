"""Delimited documents of any delimiter to rows, one document per row of input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec, functions as F

from ..functions.arrays import let
from ..functions.paths import extension
from ..functions.text import text_lines

# Candidates in order; a tie goes to the later one.  Fixed values.
SNIFFED = (",", ";", "\t")


def sniff_delimiter(text: Column) -> Column:
    """Most frequent candidate outside quotes in the first non-blank line; ',' when none occurs."""
    line = F.coalesce(F.get(F.filter(text_lines(text), lambda l: F.trim(l) != ""), 0), F.lit(""))

    def most_frequent(bare: Column) -> Column:
        best, most = F.lit(","), F.regexp_count(bare, F.lit(","))
        for candidate in SNIFFED[1:]:
            n = F.regexp_count(bare, F.lit(candidate))
            wins = (n > 0) & (n >= most)
            best, most = F.when(wins, candidate).otherwise(best), F.greatest(n, most)
        return best

    return let(F.regexp_replace(line, r'"[^"]*(?:"|$)', ""), most_frequent)


def delimiter_for(ext: Column, text: Column) -> Column:
    """tsv and psv are forced; anything else is sniffed."""
    return F.when(ext == "tsv", "\t").when(ext == "psv", "|").otherwise(sniff_delimiter(text))


def _parse(text: Column, delim: str) -> Column:
    d = "\\" + delim if delim == "|" else delim
    field = rf'(?:"[^"]*+(?:""[^"]*+)*+"?)?[^{d}\r\n]*+'
    record = rf"({field}(?:{d}{field})*+)(?:\r\n|\n|\r|\z)"
    records = F.filter(
        F.regexp_extract_all(text, F.lit(record), F.lit(1)), lambda r: ~r.isin("", '""')
    )

    def clean(raw: Column) -> Column:
        quoted = F.regexp_extract(raw, r'(?s)^"([^"]*+(?:""[^"]*+)*+)"?(.*)$', 1)
        rest = F.regexp_extract(raw, r'(?s)^"([^"]*+(?:""[^"]*+)*+)"?(.*)$', 2)
        return F.when(
            raw.startswith('"'), F.concat(F.replace(quoted, F.lit('""'), F.lit('"')), rest)
        ).otherwise(raw)

    return F.transform(
        records,
        lambda r: F.transform(
            F.regexp_extract_all(F.concat(F.lit(delim), r), F.lit(rf"{d}({field})"), F.lit(1)), clean
        ),
    )


def records(text: Column, delim: Column) -> Column:
    """Quoted-field parse of a whole text into an array of records; blank lines give none."""
    out = _parse(text, ",")
    for candidate in (";", "\t", "|"):
        out = F.when(delim == candidate, _parse(text, candidate)).otherwise(out)
    return out


def delimited_rows(
    docs: DataFrame, key: str, text: str, ext: Column | None = None, *,
    max_cols: int | None = None,
) -> DataFrame:
    """(key, delimiter, row_no, cells): row 0 is the header; ragged rows are padded to the widest.

    With ``max_cols`` wider tables are cut, and ``n_cols`` and ``truncated`` tell what there was.
    """
    ext = F.lit("csv") if ext is None else ext
    parsed = docs.select(key, delimiter_for(ext, F.col(text)).alias("delimiter"), F.col(text).alias("_t"))
    marks = ["n_cols", "truncated"] if max_cols else []

    def padded(rows: Column, widest: Column) -> Column:
        width = F.least(widest, F.lit(max_cols)) if max_cols else widest
        more = [widest.alias("n_cols"), (widest > max_cols).alias("truncated")] if max_cols else []
        return F.transform(
            rows, lambda c: F.struct(F.slice(F.concat(c, F.array_repeat(F.lit(""), width)), F.lit(1), width).alias("cells"), *more)
        )

    # An outer explode has no filter on its array put before it, which would parse every text twice.
    whole = let(records(F.col("_t"), F.col("delimiter")), lambda r: let(F.array_max(F.transform(r, F.size)), lambda w: padded(r, w)))
    rows = parsed.select(key, "delimiter", F.posexplode_outer(whole).alias("row_no", "_c")).filter("row_no IS NOT NULL")
    return rows.select(key, "delimiter", "row_no", "_c.cells", *[f"_c.{m}" for m in marks])


# How a line moves the reader: ``out`` is whether a quoted field is open behind it if none was before, ``kept``
# if one was.  A quote opens a field only as its first character.
_QUOTED = r'[^"]*+(?:""[^"]*+)*+'


def _opens(line: Column, delim: str) -> Column:
    d = "\\" + delim if delim == "|" else delim
    closed = rf'(?:"{_QUOTED}"[^{d}\r]*+|[^"{d}\r][^{d}\r]*+)?+'
    rest = rf'(?:{closed}[{d}\r])*+"{_QUOTED}\z'
    return F.struct(
        line.rlike(rf"\A{rest}").alias("out"), line.rlike(rf'\A{_QUOTED}(?:\z|"[^{d}\r]*+[{d}\r]{rest})').alias("kept")
    )


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, line, value): the lines of all files, by the split that each begins in."""
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value", F.col("_metadata.file_size").alias("_size"),
    )


def _moves(lines: DataFrame) -> DataFrame:
    """The lines with ``set`` (open or not behind it, whatever was before; else null) and ``flips``."""
    of = _opens(F.col("value"), ",")
    for candidate in (";", "\t", "|"):
        of = F.when(F.col("delimiter") == candidate, _opens(F.col("value"), candidate)).otherwise(of)
    return lines.withColumn("_m", of).withColumns({
        "set": F.when(F.col("_m.out") == F.col("_m.kept"), F.col("_m.out").cast("int")),
        "flips": (F.col("_m.out") & ~F.col("_m.kept")).cast("int"),
    }).drop("_m")


def _state(before: WindowSpec, start: Column) -> Column:
    """Whether a field is open in front of a row: the last row that sets it, and the flips since."""
    flips = F.coalesce(F.sum("flips").over(before), F.lit(0))
    last = F.last(F.when(F.col("set").isNotNull(), F.struct("set", "turns")), ignorenulls=True).over(before)
    return F.pmod(F.when(last.isNull(), start + flips).otherwise(last["set"] + flips - last["turns"]), F.lit(2))


def scan_delimited(spark: SparkSession, path: str) -> DataFrame:
    """(path, delimiter, row_no, cells) of the delimited files below a folder, as ``delimited_rows`` gives them.

    A file is read in its splits.  Every line leaves a quoted field open, closed, as it was or the other
    way round; composed over a split, and then over the splits of a file in order, this tells for each
    split how it begins, so its records are found without the ones before.  A record that goes on in
    later splits is put together from one part of each.  The file name decides a forced delimiter.
    """
    lines = _lines(spark, path)
    place = F.struct("block", "line")
    first = lines.filter(F.trim(F.regexp_replace("value", r"\r\z", "")) != "").groupBy("path").agg(F.min_by("value", place).alias("_first"))
    # Whether a line end stands at the very end of a file: a field open there has it too.
    ended = (F.sum(F.octet_length("value") + 1) <= F.max("_size")).alias("_ended")
    delims = lines.groupBy("path").agg(ended).join(first, "path", "left").select(
        F.col("path").alias("_path"), "_ended", delimiter_for(extension(F.col("path")), F.coalesce("_first", F.lit(""))).alias("delimiter")
    )
    split = ["path", "block"]
    so_far = Window.partitionBy(*split).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*split).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    moved = _moves(lines.join(delims, F.col("path") == F.col("_path")).drop("_path"))
    moved = moved.withColumn("turns", F.sum("flips").over(so_far))

    # One row a split: what all its lines do together, then what all splits before it do.
    whole = moved.groupBy(*split).agg(
        F.max_by(F.struct("set", "turns"), F.when(F.col("set").isNotNull(), F.col("line"))).alias("_last"), F.sum("flips").alias("_flips")
    )
    whole = whole.select(
        *split, F.pmod(F.col("_last.set") + F.col("_flips") - F.col("_last.turns"), F.lit(2)).alias("set"),
        F.when(F.col("_last").isNull(), F.pmod("_flips", F.lit(2))).otherwise(0).alias("flips"),
    )
    in_file = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    in_front = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("turns", F.sum("flips").over(in_file)).withColumn("_open", _state(in_front, F.lit(0)))
    opens = whole.select(F.col("path").alias("_path"), F.col("block").alias("_block"), "_open")

    here = (F.col("path") == F.col("_path")) & (F.col("block") == F.col("_block"))
    begun = moved.join(opens, here).withColumn("_begins", (_state(before, F.col("_open")) == 0).cast("int"))
    begun = begun.select(*split, "line", "value", "delimiter", "_ended", F.sum("_begins").over(so_far).alias("_record"))
    parts = begun.groupBy(*split, "delimiter", "_ended", "_record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda r: r["value"]), "\n").alias("_text")
    )
    # The head of a split belongs to the last record begun in the splits before it.
    last_begun = F.last(F.when(F.col("_n") > 0, F.struct("block", F.col("_n").alias("n"))), ignorenulls=True).over(in_front)
    numbers = parts.groupBy(*split).agg(F.max("_record").alias("_n"))
    final = numbers.filter("_n > 0").groupBy("path").agg(F.max(F.struct("block", "_n")).alias("_final"))
    owners = numbers.select(
        F.col("path").alias("_path"), F.col("block").alias("_block"), last_begun.alias("_owner")
    )
    heads = parts.filter("_record = 0").join(owners, here).select(
        F.col("path").alias("_path"), F.col("_owner.block").alias("_of"), F.col("_owner.n").alias("_at"), F.struct(F.col("block"), F.col("_text").alias("text")).alias("_more")
    )
    heads = heads.groupBy("_path", "_of", "_at").agg(F.array_sort(F.collect_list("_more")).alias("_more"))
    owned = (F.col("path") == F.col("_path")) & (F.col("block") == F.col("_of")) & (F.col("_record") == F.col("_at"))
    joined = parts.filter("_record > 0").join(heads, owned, "left").withColumn(
        "_text", F.array_join(F.concat(F.array("_text"), F.coalesce(F.col("_more.text"), F.array().cast("array<string>"))), "\n")
    ).join(final, "path")
    at_end = F.col("_ended") & (F.col("block") == F.col("_final.block")) & (F.col("_record") == F.col("_final._n"))
    joined = joined.withColumn("_text", F.when(at_end, F.concat("_text", F.lit("\n"))).otherwise(F.col("_text")))
    cells = joined.select(
        *split, "delimiter", "_record", F.posexplode(records(F.col("_text"), F.col("delimiter"))).alias("_pos", "_cells")
    )
    # Rows are numbered in their split and shifted by those of the splits before.
    numbered = cells.withColumn("_nth", F.row_number().over(Window.partitionBy(*split).orderBy("_record", "_pos")))
    counts = cells.groupBy(*split).agg(F.count("*").alias("_rows"), F.max(F.size("_cells")).alias("_wide")).select(
        F.col("path").alias("_path"), F.col("block").alias("_block"), F.coalesce(F.sum("_rows").over(in_front), F.lit(0)).alias("_ahead"),
        F.max("_wide").over(Window.partitionBy("path")).alias("_w"),
    )
    return numbered.join(counts, here).select(
        "path", "delimiter", (F.col("_ahead") + F.col("_nth") - 1).cast("int").alias("row_no"),
        F.slice(F.concat("_cells", F.array_repeat(F.lit(""), F.col("_w"))), F.lit(1), F.col("_w")).alias("cells"),
    )
