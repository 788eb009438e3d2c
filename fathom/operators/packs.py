"""Listing and validation of a knowledge pack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import casefold

REQUIRED = ("license", "languages", "name", "source", "version")
ISSUE = "severity string, message string"


def list_knowledge(kb: DataFrame, language: str | None = None) -> DataFrame:
    """path, title, language, tags and priority by language, casefolded title and path."""
    own = kb if not language else kb.filter(casefold(F.col("language")) == casefold(F.lit(language)))
    return own.select("path", "title", "language", "tags", "priority").orderBy("language", casefold(F.col("title")), "path")


def in_section(path: Column, language: Column) -> Column:
    """Whether a path lies in its language's folder."""
    p, section = casefold(F.replace(path, F.lit("\\"), F.lit("/"))), F.concat(casefold(language), F.lit("/"))
    return F.startswith(p, section) | F.contains(p, F.concat(F.lit("/"), section))


def validate_pack(kb: DataFrame, manifest: dict | None) -> DataFrame:
    """(severity, message); the pack is sound when there is no error. One aggregation over the documents."""
    spark = kb.sparkSession
    manifest = manifest or {}
    languages = manifest.get("languages") or []
    languages = [languages] if isinstance(languages, str) else list(languages)
    known = F.col("language") != "unknown"
    facts = kb.agg(
        F.count("*").alias("documents"), F.array_sort(F.collect_set(F.when(known, F.col("language")))).alias("languages"), F.count_if(~known).alias("unknown"),
        F.count_if(known & ~in_section(F.col("path"), F.col("language"))).alias("misplaced"), F.count_if(F.size("tags") == 0).alias("untagged"),
    ).first()
    issues = [("error", "pack contains no Markdown documents")] * (facts["documents"] == 0)
    if manifest:
        issues += [("error", f"manifest missing required field: {name}") for name in REQUIRED if manifest.get(name) in (None, "", [])]
    else:
        issues.append(("error", "missing manifest"))
        languages = facts["languages"]  # a pack without a manifest has the languages of its documents
    if facts["languages"] and not languages:
        issues.append(("error", "manifest languages do not describe document languages"))
    issues += [("error", f"manifest languages missing document language: {name}") for name in facts["languages"] if name not in languages]
    for name, what in (("unknown", "do not declare a language"), ("misplaced", "are outside their language section"), ("untagged", "do not declare tags")):
        if facts[name]:
            issues.append(("warning", f"{facts[name]} document(s) {what}"))
    return spark.createDataFrame(issues, ISSUE)
