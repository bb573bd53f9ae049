"""One query for each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.llm import bpe, chat, exact_dedup, packing, quality, sharding, simhash, substring_dedup, token_files, tokens, warc
from fieldbook.llm import new_queries
from fieldbook.llm.common import read_table, shared_dir


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    read = chat.parse(chat.format_conversations(rows))
    learned = F.array_join("learned", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.expr(r"array_join(transform(turns, t -> concat(t.role, '\n', t.text, '\n')), '')").cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_blocks",
    )


OP4_SQL = r"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (
  SELECT *, replace(replace(text, '\', '\b'), '<', '\l') AS safe,
    length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g')) AS role_chars,
    lag(role) OVER w AS prior, row_number() OVER w AS i
  FROM raw WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(length(safe) + CASE WHEN prior IS NULL THEN 8 + role_chars WHEN prior = role THEN 6 ELSE 16 + role_chars END) + 8)::BIGINT AS formatted_chars,
  count(*) FILTER (prior IS NULL OR prior <> role) AS n_blocks
FROM t GROUP BY conv_id
"""


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.with_groups(docs).select(
        "doc_id", F.col("dedup_keep_id").alias("keep_id"), F.col("dedup_size").alias("group_size"),
        F.col("dedup_kept").alias("kept"), F.col("dedup_sha256").alias("text_sha256"),
    )


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality.judge(docs).select("doc_id", *quality.MEASURES, "base_failed", "kept")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (
    SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d))),
rep AS (
  SELECT doc_id, count(DISTINCT k)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM grams WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, host, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT host, count(*) AS docs, count(*) FILTER (base_failed) AS failed FROM b GROUP BY host),
p AS (SELECT coalesce(avg(failed / docs), 0) AS m, var_pop(failed / docs) AS v FROM h),
q AS (SELECT m, CASE WHEN v > 0 THEN least(1000.0, greatest(1.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS k FROM p),
r AS (SELECT host, (failed + m * k) / (docs + k) AS rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.8 AS kept
FROM b JOIN r USING (host)
"""


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law")
    )
    placed = sharding.assign(docs, "doc_id", 16, 17, then=("text_crc32",))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


QUERIES = {
    "op4_chat_formatting": op4_chat_formatting,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_sharding": op10_sharding,
}
ORACLE_SQL = {"op4_chat_formatting": OP4_SQL, "op8_exact_dedup": OP8_SQL, "op9_quality_rules": OP9_SQL}


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.without_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, source = f"{shared_dir(spark)}/ids", _path("word_bpe_49k.json")
    token_files.write(read_table(spark, sf_dir, "documents"), lambda: tokens.word_level(source), 1, path)
    return token_files.read(spark, path)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc"
    warc.write(read_table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _path("byte_bpe_50k.json")
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), lambda: tokens.byte_level(source), 0, 2048)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return bpe.round_trip_digests(docs, _path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES |= {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_files": op2_token_files,
    "op3_warc": op3_warc,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_byte_bpe": op7_byte_bpe,
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
QUERIES |= new_queries.QUERIES
ORACLE_SQL |= new_queries.ORACLE_SQL
