"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from scenara.llm import (
    chat_format,
    clustering,
    decontamination,
    language_id,
    license_scan,
    near_dedup,
    packing,
    quality_rules,
    source_mix,
    spelling,
    substring_dedup,
    token_counts,
    top_k,
)
from scenara.llm.common import table
from scenara.llm.oracle import CONTAMINATION, clusters

TOKEN_LIMIT = 512


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digest(table(spark, sf_dir, "documents"), passage=corpus_pipeline.PASSAGE_BYTES)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digest(chat_format.format_chats(rows.unionByName(chat_format.planted(spark))))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return top_k.top_k(rows.where(F.col("id").isNotNull()), F.col("id") % 50 == 0, "vector", 5)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.class_of_documents(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    names, network = language_id.train(language_id.training_sample(docs))
    return language_id.identify(docs, names, network)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return source_mix.mix_counts(docs)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes(F.col("failed"), quality_rules.BASE)).alias("base_failed"),
        quality_rules.passes(F.col("failed"), quality_rules.CORPUS).alias("kept"),
        "failed",
    )


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.digest(found)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


CLUSTERS, COMPONENTS, ROUNDS = 8, 64, 10


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    found = clustering.cluster(rows, "vec_id", "embedding", CLUSTERS, COMPONENTS, ROUNDS)
    return found.withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_top_k": op4_top_k,
    "op5_packing": op5_packing,
    "op6_near_dedup": op6_near_dedup,
    "op7_language_id": op7_language_id,
    "op8_token_counts": op8_token_counts,
    "op9_source_mix": op9_source_mix,
    "op10_quality_rules": op10_quality_rules,
    "op11_decontamination": op11_decontamination,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_centroid_clusters": op13_centroid_clusters,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {
    "op11_decontamination": CONTAMINATION,
    "op13_centroid_clusters": clusters(CLUSTERS, COMPONENTS, ROUNDS),
    "op3_chat_format": r"""
        WITH source AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), escaped AS (
            SELECT *,
                replace(replace(text, '\', '\\'), '</turn>', '<\/turn>') AS safe_text,
                replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), ':', '<\c>') AS safe_role,
                contains(role || ': ' || text, '</turn>' || chr(10)) OR contains(role, ': ')
                    OR contains(role || text, '\\') OR contains(role || text, '<\/turn>') OR contains(role || text, '<\c>') AS conflict
            FROM source
        ), turns AS (
            SELECT *, length(CASE WHEN conflict THEN safe_role || safe_text ELSE role || text END) + 14 AS chars FROM escaped
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
            CAST(sum(chars) AS BIGINT) AS formatted_chars,
            true AS identical
        FROM turns GROUP BY conv_id
    """,
    "op4_top_k": """
        WITH q AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
            FROM q AS a JOIN q AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
        )
        SELECT * FROM ranked WHERE rank <= 5
    """,
    "op10_quality_rules": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r,
                list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda w: w <> '') AS words,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\v\f\r]')) AS lines
            FROM documents
        ), windows AS (
            SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
            FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM d)
        ), twice AS (
            SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1
        ), covered AS (
            SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
        ), m AS (
            SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
                CAST(length(regexp_replace(text, '[ \t\n\v\f\r]', '', 'g')) AS BIGINT) AS word_chars,
                CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(len(lines) AS BIGINT) AS n_lines,
                CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                coalesce(c.n, 0) AS n_repeat_words
            FROM d LEFT JOIN covered AS c ON d.r = c.r
        ), bits AS (
            SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 5 * word_chars)::INT
                + 8 * (100 * n_dup_lines > 40 * n_lines)::INT + 16 * (word_chars > 40 * n_words)::INT AS BIGINT) AS failed
            FROM m
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM bits
    """,
}
