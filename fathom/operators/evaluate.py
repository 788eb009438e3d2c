"""Retrieval quality of search results against cases (qid, query, expected_tag, difficulty, expected_language)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = {"expected_tag": "tag", "difficulty": "difficulty", "expected_language": "language"}


def case_results(cases: DataFrame, results: DataFrame) -> DataFrame:
    """A row a case: rank of the first expected result (null without one), reciprocal_rank, confidence and language of the top result (NONE without)."""
    fits = F.array_contains("tags", F.col("expected_tag")) & (F.col("expected_language").isNull() | (F.col("language") == F.col("expected_language")))
    found = results.join(cases.select("qid", "expected_tag", "expected_language"), "qid").groupBy("qid").agg(
        F.min(F.when(fits, F.col("rank"))).alias("rank"), F.min_by("confidence", "rank").alias("confidence"), F.min_by("language", "rank").alias("top_language")
    )
    none = lambda c: F.coalesce(c, F.lit("NONE")).alias(c)
    return cases.join(found, "qid", "left").select(*cases.columns, "rank", F.coalesce(1 / F.col("rank"), F.lit(0.0)).alias("reciprocal_rank"), none("confidence"), none("top_language"))


def _quality() -> list[Column]:
    share = lambda c: F.round(F.coalesce(F.avg(c.cast("double")), F.lit(0.0)), 6)
    first, any_rank = F.coalesce(F.col("rank") == 1, F.lit(False)), F.col("rank").isNotNull()
    return [
        F.count("*").alias("total"), F.count_if(first).alias("top_1_correct"), F.count_if(any_rank).alias("top_k_correct"),
        share(first).alias("top_1_accuracy"), share(any_rank).alias("top_k_accuracy"), share(F.col("reciprocal_rank")).alias("mean_reciprocal_rank"),
    ]


def metrics(of_cases: DataFrame) -> DataFrame:
    """One row, also of no case: accuracy, mean reciprocal rank and the top results' confidence counts."""
    counts = [F.count_if(F.col("confidence") == c).alias(c.lower()) for c in ("HIGH", "MEDIUM", "LOW", "NONE")]
    return of_cases.agg(*_quality(), *counts)


def buckets(of_cases: DataFrame) -> DataFrame:
    """(kind, bucket, quality...) by expected tag, difficulty and expected language, in one pass over grouping sets."""
    rows = of_cases.withColumn("expected_language", F.coalesce("expected_language", F.lit("unspecified")))
    sets = rows.groupingSets([[F.col(c)] for c in BUCKETS], *[F.col(c) for c in BUCKETS])
    found = sets.agg(*_quality(), *[F.grouping(c).alias(f"_{c}") for c in BUCKETS])
    kind = F.coalesce(*[F.when(F.col(f"_{c}") == 0, F.lit(name)) for c, name in BUCKETS.items()])
    return found.select(kind.alias("kind"), F.coalesce(*BUCKETS).alias("bucket"), "total", "top_1_correct", "top_k_correct", "top_1_accuracy", "top_k_accuracy", "mean_reciprocal_rank")


def top_languages(of_cases: DataFrame) -> DataFrame:
    return of_cases.groupBy("top_language").agg(F.count("*").alias("cases")).orderBy("top_language")


def latency_summary(samples: DataFrame, column: str) -> DataFrame:
    """One row: mean, min, max and p95, the sample at index floor(0.95 n) of those in order.

    The rank is found by counts per distinct value, so no list of all samples is held anywhere.
    """
    values = samples.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    ends = values.agg(F.count("*").alias("samples"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    at = F.least(F.floor(F.col("samples") * 0.95), F.col("samples") - 1) / F.greatest(F.col("samples") - 1, F.lit(1))
    share = ends.select(at).first()[0] if not samples.isEmpty() else 0.0
    p95 = values.agg(F.percentile("v", F.lit(float(share or 0.0))).alias("p95"))
    rounded = [F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("mean", "min", "max", "p95")]
    return ends.crossJoin(p95).select("samples", *rounded)
