"""The registered query of each operator: production parameters, whole tables, whole results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..scratch import scratch_path
from . import (
    alignment, chat, decontam, langid, packing, pieces, planes, quality, resample, rules, shards, simhash, suffixes,
)
from .common import documents, remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@_query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_print(F.col("fingerprint")).alias("fingerprint"), "component_id")


@_query
def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixes.without_repeats(documents(spark, sf_dir))
    return left.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@_query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encode_documents(documents(spark, sf_dir), model, with_decoded=False)


@_query
def op10_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    planes.write_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), path)
    return planes.read_tokens(spark, path)


@_query
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.sql(
        "SELECT -1L AS conv_id, CAST(turn AS BIGINT) AS turn, role, :said AS text "
        "FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)",
        args={"said": said},
    )
    told = chat.format_chats(rows.unionByName(more))
    read = told.select(
        "conv_id", "valid", "formatted",
        chat.turns_of(F.col("formatted")).alias("turns"),
        chat.trained_text(F.col("segments")).alias("trained"),
    )
    line = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


ORACLES["op1_chat_format"] = r"""
WITH told AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL
  SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(role) + 1 + length(text)
      + len(regexp_extract_all(text, '<\\*\|')) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars,
  regexp_full_match(
    string_agg(CASE role WHEN 'system' THEN 'S' WHEN 'user' THEN 'U' WHEN 'assistant' THEN 'A' ELSE 'X' END,
               '' ORDER BY turn, role, text),
    'S?(UA)+') AS valid
FROM told GROUP BY conv_id
"""


@_query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.assign(documents(spark, sf_dir))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def _held_out_lang() -> Column:
    return remainder(F.col("doc_id"), 4) == 2


@_query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.learn(docs.filter(~_held_out_lang()))
    return langid.identify(docs, model).select("doc_id", _held_out_lang().alias("held_out"), "lang_pred", "score")


@_query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = remainder(F.col("doc_id"), 3) == 1
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out)
    weights = quality.fit(docs, labels.select("doc_id", F.col("quality").alias("label")))
    scored = quality.score(docs, weights)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@_query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.contaminated(documents(spark, sf_dir), benchmark)
    return found.select(
        "doc_id", "item_id", F.col("equal_words").cast("long").alias("equal_words"),
        F.col("of_words").cast("long").alias("of_words"),
    )


# Every way to lay an item on a text at which the rule may hold: there some neighbouring words are equal, as many
# as the allowed substitutions must leave together.
ORACLES["op6_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS t FROM documents
), b AS (
  SELECT item_id, t, least(len(t), 16) AS w, ceil(least(len(t), 16) * 0.75) AS least_equal
  FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS t FROM benchmark)
  WHERE len(t) > 0
), r AS (
  SELECT *, ceil(least_equal / (w - least_equal + 1)) AS run FROM b
), ds AS (
  SELECT doc_id, pos, run, list_slice(t, pos, pos + run - 1) AS gram
  FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS pos FROM d), (SELECT DISTINCT CAST(run AS BIGINT) AS run FROM r)
), bs AS (
  SELECT item_id, pos, run, list_slice(t, pos, pos + run - 1) AS gram
  FROM (SELECT item_id, CAST(run AS BIGINT) AS run, t, unnest(range(1, len(t) - CAST(run AS BIGINT) + 2)) AS pos FROM r)
), ways AS (
  SELECT DISTINCT doc_id, item_id, ds.pos - bs.pos AS shift FROM ds JOIN bs USING (run, gram)
), laid AS (
  SELECT doc_id, item_id, r.w, r.least_equal, len(r.t) AS n,
    list_transform(range(1, len(r.t) + 1), lambda k: CASE WHEN k + shift >= 1 AND d.t[k + shift] = r.t[k] THEN 1 ELSE 0 END) AS eq
  FROM ways JOIN d USING (doc_id) JOIN r USING (item_id)
), most AS (
  SELECT doc_id, item_id, w, least_equal, list_max(list_transform(range(1, n - w + 2), lambda s: list_sum(eq[s:s + w - 1]))) AS e FROM laid
)
SELECT doc_id, item_id, max(e)::BIGINT AS equal_words, max(w)::BIGINT AS of_words
FROM most WHERE e >= least_equal GROUP BY doc_id, item_id
"""


@_query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir)).drop("distance")


@_query
def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resample.resample(documents(spark, sf_dir), benchmark)


@_query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@_query
def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = alignment.align_documents(documents(spark, sf_dir), *paths)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
