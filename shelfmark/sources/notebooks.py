"""Notebook documents to cell rows and attached pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import strip_ansi


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _text(value: Column) -> Column:
    """A text that may be stored as one string or as an array of strings."""
    parts = F.filter(
        F.transform(
            F.when(_is(value, "ARRAY"), value).cast("array<variant>"),
            lambda v: F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string")),
        ),
        lambda s: s.isNotNull(),
    )
    return F.coalesce(
        F.when(_is(value, "STRING"), F.try_variant_get(value, "$", "string")),
        F.array_join(parts, ""),
        F.lit(""),
    )


def _field(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _output(output: Column) -> Column:
    kind = F.try_variant_get(output, "$.output_type", "string")
    plain = _text(_field(output, "$.data['text/plain']"))
    keys = F.map_keys(_field(output, "$.data").try_cast("map<string,variant>"))
    has_image = F.coalesce(F.exists(keys, lambda k: k.startswith("image/")), F.lit(False))
    trace = F.filter(
        F.transform(
            _field(output, "$.traceback").try_cast("array<variant>"),
            lambda v: F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string")),
        ),
        lambda s: s.isNotNull(),
    )
    text = (
        F.when(kind == "stream", _text(_field(output, "$.text")))
        .when(kind.isin("execute_result", "display_data") & (plain != ""), plain)
        .when(kind == "error", strip_ansi(F.coalesce(F.array_join(trace, "\n"), F.lit(""))))
    )
    trimmed = F.regexp_replace(text, r"\s+\z", "")
    picture = F.when(kind.isin("execute_result", "display_data") & (plain == "") & has_image, "[image output]")
    return F.coalesce(F.nullif(trimmed, F.lit("")), picture)


def _parsed(docs: DataFrame, key: str, text: str) -> DataFrame:
    parsed = docs.select(key, F.col(text).alias("_t"), F.try_parse_json(text).alias("_v"))
    cells = _field(F.col("_v"), "$.cells")
    return parsed.withColumn("_cells", F.when(_is(cells, "ARRAY"), cells).cast("array<variant>"))


def notebook_cells(docs: DataFrame, key: str, text: str, max_cells: int | None = None) -> DataFrame:
    """(key, cell, kind, source, outputs, lang, n_cells): the cells of every notebook.

    A text that is not a notebook stays whole as a single ``raw-json`` row; a notebook without
    cells is one row without a cell.  ``max_cells`` keeps the first cells only: ``n_cells`` has
    the true number, and a ``truncated`` column says whether some were left out.
    """
    v = F.col("_v")
    lang = F.coalesce(
        F.try_variant_get(v, "$.metadata.kernelspec.language", "string"),
        F.try_variant_get(v, "$.metadata.language_info.name", "string"),
        F.lit("python"),
    )

    def cell(c: Column, i: Column) -> Column:
        kind = F.coalesce(F.try_variant_get(c, "$.cell_type", "string"), F.lit(""))
        source = _text(_field(c, "$.source"))
        rewritten = F.replace(
            source, F.lit("](attachment:"), F.concat(F.lit("](c"), i.cast("string"), F.lit("/attachment:"))
        )
        outputs = F.filter(
            F.transform(_field(c, "$.outputs").try_cast("array<variant>"), _output),
            lambda o: o.isNotNull(),
        )
        return F.struct(
            i.cast("int").alias("cell"), kind.alias("kind"),
            F.regexp_replace(F.when(kind == "markdown", rewritten).otherwise(source), r"\s+\z", "").alias("source"),
            F.when(kind == "code", F.coalesce(F.array_join(outputs, "\n"), F.lit(""))).otherwise("").alias("outputs"),
        )

    cells = F.transform(F.slice("_cells", 1, max_cells) if max_cells else F.col("_cells"), cell)
    raw = F.array(F.struct(
        F.lit(0).alias("cell"), F.lit("raw-json").alias("kind"), F.col("_t").alias("source"),
        F.lit("").alias("outputs"),
    ))
    return (
        _parsed(docs, key, text)
        .select(
            key, lang.alias("lang"), F.size("_cells").alias("_n"),
            F.explode_outer(F.coalesce(cells, raw)).alias("_c"),
        )
        .select(
            key, "_c.*", F.when(F.col("_c.kind") == "raw-json", "json").otherwise(F.col("lang")).alias("lang"),
            F.when(F.col("_c.kind") == "raw-json", 1).otherwise(F.col("_n")).alias("n_cells"),
            *([(F.col("_n") > max_cells).alias("truncated")] if max_cells else []),
        )
    )


_BASE64 = r"^(?:[A-Za-z0-9+/]{4})*+(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"


def attachments(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, content): all pictures pasted into Markdown cells, named ``c<cell>/attachment:<name>``."""

    def of_cell(c: Column, i: Column) -> Column:
        files = F.map_entries(_field(c, "$.attachments").try_cast("map<string,variant>"))

        def picture(entry: Column) -> Column:
            kinds = F.map_entries(entry["value"].try_cast("map<string,variant>"))
            first = F.get(F.filter(kinds, lambda k: k["key"].startswith("image/")), 0)["value"]
            packed = F.regexp_replace(
                F.when(_is(first, "STRING"), F.try_variant_get(first, "$", "string")), r"\s+", ""
            )
            return F.struct(
                F.concat(F.lit("c"), i.cast("string"), F.lit("/attachment:"), entry["key"]).alias("name"),
                F.when(packed.rlike(_BASE64) & (packed != ""), F.unbase64(packed)).alias("content"),
            )

        pictures = F.transform(files, picture)
        is_md = F.try_variant_get(c, "$.cell_type", "string") == "markdown"
        return F.coalesce(
            F.when(is_md, F.filter(pictures, lambda p: p["content"].isNotNull())),
            F.array().cast("array<struct<name:string,content:binary>>"),
        )

    found = F.flatten(F.transform("_cells", of_cell))
    return (
        _parsed(docs, key, text)
        .select(key, F.explode(found).alias("_a"))
        .select(key, "_a.name", "_a.content")
    )
