"""Operator 8: byte-level BPE token counts by rank-synchronous array merging.

Pre-tokens are held as one ragged array of symbol numbers. In each round every sequence's lowest-rank pair
merges at once, at all of its places (of overlapping ones the left); a merge only makes pairs of higher rank
than its own, so that is what one merge at a time gives. Ranks are looked up again only beside what merged.
Sequences without a mergeable pair leave with their length as their token count. Distinct pre-tokens are
merged once and remembered while memory allows (forgetting changes no result).

Plan: a map over the text column in Arrow batches; no shuffle. The broadcast tables depend on the
vocabulary alone.

Defined results: a null text has null counts, an empty one 0. Special tokens' strings are ordinary text.
Repeated rows get equal counts. Other columns are never read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.scratch import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits contractions, letters, digits, other marks and white space, each with one blank before it.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 200_000
CHUNK_CHARS = 1_000_000
_NONE = np.int64(1) << np.int64(40)


def load_merges(path: str) -> dict[str, np.ndarray]:
    """Sorted pair keys (left << 20 | right) with the merged symbol, which is also the rank; and the symbol of each byte."""
    with open(path, "rb") as lines:
        rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    pairs = {}
    for token, r in rank.items():
        for k in range(1, len(token)):
            a, b = rank.get(token[:k]), rank.get(token[k:])
            if a is not None and b is not None:
                pairs[a << 20 | b] = r
    keys = np.array(sorted(pairs), np.int64)
    return {"keys": keys, "merged": np.array([pairs[k] for k in keys.tolist()], np.int64), "bytes": np.array([rank[bytes([b])] for b in range(256)], np.int64)}


def _ranks(merges: dict, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    key = left << 20 | right
    at = np.minimum(np.searchsorted(merges["keys"], key), len(merges["keys"]) - 1)
    return np.where(merges["keys"][at] == key, merges["merged"][at], _NONE)


def count_symbols(merges: dict, sequences: list[bytes]) -> np.ndarray:
    """Symbols that survive in each sequence."""
    size = np.array([len(x) for x in sequences], np.int64)
    out = size.copy()
    own = np.flatnonzero(size > 1)
    flat = merges["bytes"][np.frombuffer(b"".join(sequences), np.uint8)][np.repeat(size > 1, size)]
    size = size[own]
    rank = np.full(len(flat), _NONE)
    if len(flat):
        rank[:-1] = _ranks(merges, flat[:-1], flat[1:])
        rank[np.cumsum(size) - 1] = _NONE
    while len(own):
        first = np.cumsum(size) - size
        least = np.minimum.reduceat(rank, first)
        going = least < _NONE
        if not going.all():
            out[own[~going]] = size[~going]
            stay = np.repeat(going, size)
            flat, rank, size, own, least = flat[stay], rank[stay], size[going], own[going], least[going]
            if not len(own):
                break
            first = np.cumsum(size) - size
        hit = rank == np.repeat(least, size)
        place = np.flatnonzero(hit)
        # of pairs that overlap, as in a run of one symbol, every other one from the left
        begin = np.r_[True, np.diff(place) > 1]
        place = place[(np.arange(len(place)) - np.maximum.accumulate(np.where(begin, np.arange(len(place)), 0))) % 2 == 0]
        flat[place] = rank[place]
        # The merged symbol stands at the right one's end of the sequence if that was its last.
        ends = np.zeros(len(flat), bool)
        ends[np.cumsum(size) - 1] = True
        ended = ends[place + 1]
        keep = np.ones(len(flat), bool)
        keep[place + 1] = False
        size = size - np.add.reduceat((~keep).astype(np.int64), first)
        new = place - np.arange(len(place))  # where the merged symbols are afterwards
        flat, rank = flat[keep], rank[keep]
        inner = new[~ended]
        rank[new[ended]] = _NONE
        rank[inner] = _ranks(merges, flat[inner], flat[inner + 1])
        start = np.zeros(len(flat), bool)
        start[np.cumsum(size) - size] = True
        before = new[~start[new]] - 1
        rank[before] = _ranks(merges, flat[before], flat[before + 1])
    return out


class Counter:
    """Counts texts' tokens, remembering distinct pre-tokens."""

    def __init__(self, merges: dict):
        self.merges, self.known, self.split = merges, {}, regex.compile(PATTERN).findall

    def __call__(self, texts: list[str | None]) -> tuple[list[int | None], list[int | None]]:
        tokens, pieces, i = [], [], 0
        while i < len(texts):
            j, chars = i, 0
            while j < len(texts) and (j == i or chars + len(texts[j] or "") <= CHUNK_CHARS):
                chars += len(texts[j] or "")
                j += 1
            split = [None if t is None else self.split(t) for t in texts[i:j]]
            if len(self.known) > REMEMBERED:
                self.known.clear()
            new = list({p for s in split if s for p in set(s).difference(self.known)})
            if new:
                self.known.update(zip(new, count_symbols(self.merges, [p.encode() for p in new]).tolist()))
            tokens += [None if s is None else sum(map(self.known.__getitem__, s)) for s in split]
            pieces += [None if s is None else len(s) for s in split]
            i = j
        return tokens, pieces


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, tokens and pre_tokens of every row."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(load_merges(vocabulary))

    @F.arrow_udf("struct<tokens: long, pre_tokens: long>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(held.value)
        for batch in batches:
            tokens, pieces = counter(batch.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), pa.array(pieces, pa.int64())], ["tokens", "pre_tokens"])

    return docs.select("doc_id", count(docs["text"].cast("string")).alias("c")).select("doc_id", "c.tokens", "c.pre_tokens")
