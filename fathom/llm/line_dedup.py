"""Operator 2: drop lines that occur in too many documents.

Plan: explode normalised lines, hash them, count distinct documents per hash, keep the hashes over the
threshold, and join them back to (document, position); each text is then split once more and reassembled
by position without those lines. Line text is never shuffled: the exploded rows carry two hashes, an id
and a position.

A line is normalised by lower-casing, collapsing runs of blanks and tabs (and carriage returns) and
trimming. Blank lines are never dropped.

Defined results: a null text stays null and an empty one empty; a document whose lines all go keeps its
row with the text ''. Rows with a null doc_id count as no document, yet common lines leave them too.
Repeated rows count once and all lose the same lines. A line repeated inside one document counts once.
All other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.scratch import cut

MAX_DOCUMENTS = 20


def normalised(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(line), "[ \\t\\r]+", " "))


def common_line_positions(docs: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """(id, tag, gone): positions of the lines to drop, by doc_id and hash of the text."""
    named = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("tag"), F.col("text").alias("text")).filter("text <> ''")
    lines = named.select("id", "tag", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    hashed = cut(lines.withColumn("line", normalised("line")).filter("line <> ''").select("id", "tag", "at", F.xxhash64("line").alias("line")), "lines")
    over = hashed.select("line", "id").distinct().groupBy("line").agg(F.count("id").alias("n")).filter(F.col("n") > max_documents).select("line")
    return hashed.join(over, "line", "left_semi").groupBy("id", "tag").agg(F.collect_set("at").alias("gone"))


def line_dedup(docs: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """docs with each text rebuilt from the lines that at most max_documents documents have."""
    marks = common_line_positions(docs, max_documents).select(F.col("id").alias("__fathom_id"), F.col("tag").alias("__fathom_tag"), F.col("gone").alias("__fathom_gone"))
    joined = docs.join(marks, docs["doc_id"].eqNullSafe(F.col("__fathom_id")) & (F.xxhash64(docs["text"]) == F.col("__fathom_tag")), "left")
    left = F.filter(F.split(docs["text"], "\n", -1), lambda _, i: ~F.array_contains("__fathom_gone", i))
    rebuilt = F.when(F.col("__fathom_gone").isNull(), docs["text"]).otherwise(F.array_join(left, "\n"))
    return joined.select(*[rebuilt.alias(c) if c == "text" else docs[c] for c in docs.columns])
