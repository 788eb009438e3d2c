"""N-gram transitions of a corpus, and the greedy walk over a passage's own transitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from fathom.functions import batches
from fathom.functions.chunking import tokenise
from fathom.functions.text import tokens
from fathom.operators.postings import all_text

LONGEST_NOTE = 26


def _grams(order: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The n-grams of texts with their counts in a slice, where their numbers fit; else one by one."""

    def of_slice(texts: pa.Array) -> pa.RecordBatch:
        words, begins = batches.flat_tokens(texts)
        names = words.dictionary_encode()
        codes, own = names.indices.to_numpy().astype(np.int64), batches.owners(begins)
        at = np.flatnonzero(np.arange(len(codes)) + order < begins[1:][own])
        parts = [codes[at + k] for k in range(order + 1)]
        n = np.ones(len(at), np.int64)
        if (width := max(len(names.dictionary), 1)) ** (order + 1) < 1 << 63:
            key = parts[0]
            for p in parts[1:]:
                key = key * width + p
            key, n = np.unique(key, return_counts=True)
            parts = [key // width ** (order - k) % width for k in range(order + 1)]
        said = [names.dictionary.take(pa.array(p)) for p in parts]
        prefix = pc.binary_join_element_wise(*said[:-1], " ") if order > 1 else said[0]
        return pa.record_batch([prefix, said[-1], pa.array(n, pa.int64())], ["prefix", "next", "n"])

    return lambda given: (of_slice(part.column(0)) for batch in given for part in batches.slices(batch))


def _each(kb: DataFrame, order: int) -> DataFrame:
    if order < 1:
        raise ValueError("the order must be 1 or more")
    return kb.select(all_text().alias("t")).mapInArrow(_grams(order), "prefix string, next string, n long")


def transitions(kb: DataFrame, order: int = 2) -> DataFrame:
    """(prefix, next, n): the order tokens before each token, joined by a blank."""
    return _each(kb, order).groupBy("prefix", "next").agg(F.sum("n").alias("n"))


def vocabulary(kb: DataFrame) -> DataFrame:
    """(token): the distinct alphabetic tokens."""
    return kb.select(F.explode(tokens(all_text())).alias("token")).filter(F.col("token").rlike("^[a-z]+$")).distinct()


@F.arrow_udf(LongType())
def _sizes(text: pa.Array) -> pa.Array:
    return batches.joined([pa.array(np.diff(batches.flat_tokens(part.column(0))[1]), pa.int64()) for part in batches.slices(pa.record_batch([text], ["t"]))], pa.int64())


def model_summary(kb: DataFrame, order: int = 2) -> DataFrame:
    """One row: order, documents, tokens, distinct prefixes (transition_count) and distinct pairs. Pairs are shuffled once, by their prefix."""
    totals = kb.select(_sizes(all_text()).alias("n")).agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("token_count"))
    pairs = _each(kb, order).select("prefix", "next").repartition("prefix").distinct().groupBy("prefix").agg(F.count("*").alias("n"))
    pairs = pairs.agg(F.count("*").alias("transition_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("pair_count"))
    return totals.crossJoin(pairs).select(F.lit(order).alias("order"), "documents", "token_count", "transition_count", "pair_count")


def walk(text: str, seed: str, order: int = 2, most: int = LONGEST_NOTE) -> str:
    """From the seed's prefix along each prefix's first successor; '' where the text has no transition."""
    said = [t for t in tokenise(text) if t.isalpha()]
    follows: dict[tuple[str, ...], str] = {}
    for k in range(len(said) - order):
        follows.setdefault(tuple(said[k : k + order]), said[k + order])
    if not follows:
        return ""
    known = set(said)
    seeds = [t for t in tokenise(seed) if t in known]
    at = tuple(seeds[-order:])
    if at not in follows:
        at = next((p for p in follows if not known.isdisjoint(p) and not set(seeds).isdisjoint(p)), min(follows))
    out, seen = list(at), set()
    while len(out) < most and at in follows and at not in seen:
        seen.add(at)
        out.append(follows[at])
        at = tuple(out[-order:])
    return " ".join(out[:most])


@F.arrow_udf(StringType())
def generate_from(text: pa.Array, seed: pa.Array) -> pa.Array:
    """walk() of each row; null where a side is null. The walk is a recurrence, so it isn't a column expression."""
    return pa.array([None if t is None or s is None else walk(t, s) for t, s in zip(text.to_pylist(), seed.to_pylist())], pa.string())
