"""Registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import decontaminate, gif_media, line_dedup, lm_score, mixing, near_dedup, secret_scan, substring_dedup, token_counts, toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir))


OP2_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), clean AS (
  SELECT doc_id, pos, line, trim(regexp_replace(lower(line), '[ \\t\\r]+', ' ', 'g')) AS norm FROM lines
), common AS (
  SELECT norm FROM clean WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT doc_id) > {line_dedup.MAX_DOCUMENTS}
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM clean WHERE norm NOT IN (SELECT norm FROM common) GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, d.lang, d.source, d.n_chars
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(documents(spark, sf_dir))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(documents(spark, sf_dir))


def op5_benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_gif_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return gif_media.gif_frames(pages.select("page_id", gif_media.render(pages["html"]).alias("gif")), "page_id", "gif")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir))


OP6_SQL = f"""
WITH placed AS (
  SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n]+')) AS tokens
  FROM documents
), weights(source, weight) AS (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in mixing.WEIGHTS.items())}
), have AS (SELECT source, weight, sum(tokens)::DOUBLE AS n FROM placed JOIN weights USING (source) GROUP BY ALL
), whole AS (SELECT sum(weight) AS whole FROM have
), total AS (SELECT coalesce(min(n * whole / weight) FILTER (n > 0), 0) AS total FROM have, whole
), budget AS (SELECT source, floor(total * weight / whole + 1e-6) AS budget FROM have, whole, total
), reached AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY place) AS reached FROM placed)
SELECT doc_id, text, lang, r.source, n_chars FROM reached r JOIN budget b ON r.source = b.source WHERE reached <= budget
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_line_dedup": op2_line_dedup,
    "op3_repeated_passages": op3_repeated_passages,
    "op4_lm_scores": op4_lm_scores,
    "op5_benchmark_matches": op5_benchmark_matches,
    "op6_mix_sources": op6_mix_sources,
    "op7_gif_frames": op7_gif_frames,
    "op8_token_counts": op8_token_counts,
    "op9_toxicity": op9_toxicity,
    "op10_secrets": op10_secrets,
}
ORACLE_SQL: dict[str, str] = {"op2_line_dedup": OP2_SQL, "op6_mix_sources": OP6_SQL}
