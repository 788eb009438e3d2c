"""Term statistics of a knowledge table (path, title, body, language, tags, priority)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from fathom.functions import batches
from fathom.functions.text import tokens


def all_text() -> Column:
    """Title, tags and body; their tokens are the three fields' tokens."""
    return F.concat_ws(" ", "title", F.array_join("tags", " "), "body")


_TERM = pa.struct([("token", pa.string()), ("n", pa.int64())])


def _term_lists(texts: pa.Array) -> pa.ListArray:
    """Each text's distinct tokens in order, with their counts."""
    words, begins = batches.flat_tokens(texts)
    codes, names = batches.coded(words)
    width = max(len(names), 1)
    pairs, n = np.unique(batches.owners(begins) * width + codes, return_counts=True)
    terms = pa.StructArray.from_arrays([names.take(pa.array(pairs % width)), pa.array(n, pa.int64())], fields=list(_TERM))
    return batches.listed(np.searchsorted(pairs, np.arange(len(texts) + 1) * width), terms)


@F.arrow_udf(ArrayType(StructType([StructField("token", StringType()), StructField("n", LongType())])))
def term_counts(text: pa.Array) -> pa.Array:
    """The distinct tokens of each text in order, with their counts."""
    return batches.joined([_term_lists(part.column(0)) for part in batches.slices(pa.record_batch([text], ["t"]))], pa.list_(_TERM))


def term_frequency(kb: DataFrame) -> DataFrame:
    """(path, token, n); counted a document before the shuffle."""
    return kb.select("path", F.inline(term_counts(all_text()))).groupBy("path", "token").agg(F.sum("n").alias("n"))


def doc_frequency(kb: DataFrame) -> DataFrame:
    """(token, df)"""
    return term_frequency(kb).groupBy("token").agg(F.count("*").alias("df"))


def with_tokens(kb: DataFrame) -> DataFrame:
    """kb's path, language and priority, the three fields' tokens, and the lengths that ranking needs."""
    read = kb.select("path", "language", "priority", tokens(F.col("title")).alias("title_tokens"), tokens(F.array_join("tags", " ")).alias("tag_tokens"), tokens(F.col("body")).alias("body_tokens"))
    return read.withColumns({"body_len": F.size("body_tokens"), "bm25_len": 3 * F.size("title_tokens") + 2 * F.size("tag_tokens") + F.size("body_tokens")})


def _summed(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the texts of a slice each token's count, and a row without token for the documents and their lengths."""
    for batch in given:
        for part in batches.slices(batch):
            (titles, _), (tags, _), (bodies, _) = map(batches.flat_tokens, part.columns)
            found = pa.concat_arrays([titles, tags, bodies]).value_counts()
            fields = [pa.concat_arrays([found.field(0), pa.nulls(1, pa.string())]), pa.concat_arrays([found.field(1), pa.array([0], pa.int64())])]
            facts = [pa.array([0] * len(found) + [x], pa.int64()) for x in (len(part), 3 * len(titles) + 2 * len(tags) + len(bodies))]
            yield pa.record_batch([*fields, *facts], ["token", "n", "documents", "length"])


def corpus_stats(kb: DataFrame) -> DataFrame:
    """One row: documents, tokens, distinct terms and mean BM25 length (title three times, tags twice). One pass; what is shuffled are a slice's distinct tokens."""
    rows = kb.select("title", F.array_join("tags", " ").alias("tags"), "body").mapInArrow(_summed, "token string, n long, documents long, length long")
    terms = rows.groupBy("token").agg(*[F.sum(c).alias(c) for c in ("n", "documents", "length")])
    documents = F.coalesce(F.sum("documents"), F.lit(0))
    return terms.agg(documents.alias("documents"), F.round(F.try_divide(F.sum("length"), documents), 6).alias("mean_length"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("token").alias("terms"))


def audit_index(kb: DataFrame) -> DataFrame:
    """A row a document: its fields, the SHA-256 of its whole source, token_count and its terms with their counts, sorted.

    Texts of one path are counted together, so it is they that are shuffled, not a row a term.
    """
    own = F.struct("title", "language", "tags", "priority", "source_sha256")
    rows = kb.groupBy("path").agg(F.collect_list(own).alias("own"), F.array_join(F.collect_list(all_text()), " ").alias("text")).select("path", "own", term_counts("text").alias("t"))
    total = F.aggregate("t", F.lit(0).cast("long"), lambda s, t: s + t["n"])
    return rows.select("path", F.inline("own"), total.alias("token_count"), F.map_from_entries("t").alias("terms"))


@F.arrow_udf(IntegerType())
def count_matches(text: pa.Array, other: pa.Array) -> pa.Array:
    """How many tokens of the text, repeated ones too, the other text has."""
    parts = []
    for part in batches.slices(pa.record_batch([text, other], ["t", "o"])):
        (said, begins), (held, others) = map(batches.flat_tokens, part.columns)
        codes, names = batches.coded(pa.concat_arrays([said, held]))
        key = np.concatenate([batches.owners(begins), batches.owners(others)]) * max(len(names), 1) + codes
        found = batches.owners(begins)[np.isin(key[: len(said)], key[len(said) :])]
        parts.append(pa.array(np.bincount(found, minlength=len(part)), pa.int32()))
    return batches.joined(parts, pa.int32())
