"""Operator 4: language-model scores by deleted interpolation.

The model is over bytes of UTF-8: a byte's probability mixes the maximum-likelihood estimates of orders
1 to 5 and the uniform 1/256. The mixture weights depend on how often the 4-byte context occurs: contexts
of 2**b to 2**(b+1)-1 occurrences share bucket b. The texts fall in FOLDS folds, by a hash of doc_id and text,
and each fold has the estimates of all others, so no text is scored by counts of its own, and a copy under
another id counts only as far as it lies in another fold. The weights are learned by
expectation-maximisation on the held-out counts of the first fold against the estimates of the rest.

Plan: one pass counts 5-grams by fold (numpy over Arrow batches, partial counts leave each task, one shuffle
by n-gram); lower orders and contexts are sums over that table, which grows with the corpus's distinct
n-grams and stays in Spark, as does each step of the EM (one small aggregation). For scoring, texts are
written in blocks of BLOCK bytes; each block asks for its distinct n-grams by a join with the model, and
block and answers meet in one task. Nothing of the model passes the driver, nothing is broadcast, and the
plan is the same for every size.

Defined results: null and empty texts have no bytes, log_prob 0 and a null bits_per_byte; they add no
counts. Every row counts, repeated ones too (in one fold). Ids may be of any type, null, or repeat. With no
held-out text the weights stay uniform; a byte that the other folds never saw has the uniform share of its
bucket, which is at least LEAST. Other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.ragged import byte_chunks
from fathom.llm.scratch import cut, small_batches

ORDER = 5
BUCKETS = 40
FOLDS = 4
ROUNDS = 12
#: Least weight of the uniform estimate.
LEAST = 1e-4
#: Bytes of text that are scored together.
BLOCK = 16 << 20
_EMIT = 2_000_000
_SYMBOL = 9  # bits; 0 stands for what is before a text
_SLOT = np.uint64(0x9E3779B97F4A7C15)
_COUNTS = [f"c{f}" for f in range(FOLDS)]


def ngrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The 5-gram that ends at each byte, 9 bits a symbol, the last symbol lowest."""
    symbol = data.astype(np.uint64) + np.uint64(1)
    gram = symbol.copy()
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, ORDER):
        if len(data) > k:
            gram[k:] |= np.where(place[k:] >= k, symbol[:-k], np.uint64(0)) << np.uint64(_SYMBOL * k)
    return gram


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = (np.concatenate([p[k] for p in parts]) for k in range(2))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return (key[first], np.add.reduceat(n, first)) if len(first) else (key, n)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, fold and n of a partition; in parts if it has very many."""
    parts: list[tuple[np.ndarray, ...]] = []

    def batch_of(rows):
        return pa.record_batch([pa.array((rows[0] >> np.uint64(3)).view(np.int64)), pa.array((rows[0] & np.uint64(7)).astype(np.int32)), pa.array(rows[1])], ["gram", "fold", "n"])

    for batch in batches:
        fold = np.asarray(batch.column(1)).astype(np.uint64)
        for i, j, data, offsets in byte_chunks(batch.column(0)):
            key = ngrams(data, offsets) << np.uint64(3) | np.repeat(fold[i:j], np.diff(offsets))
            parts.append(np.unique(key, return_counts=True))
            if sum(len(p[0]) for p in parts) > _EMIT:
                parts = [_merged(parts)]
                if len(parts[0][0]) > _EMIT // 2:
                    yield batch_of(parts.pop())
    if parts:
        yield batch_of(_merged(parts))


def folded(docs: DataFrame):
    """doc_id, text and fold of every row."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", text.alias("text")).withColumn("fold", F.pmod(F.xxhash64("doc_id", "text"), F.lit(FOLDS)).cast("int"))


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, c0, c1, ...): counts by fold over all texts."""
    rows = folded(docs).filter("text <> ''").select("text", "fold").mapInArrow(_counted, "gram long, fold int, n long")
    return rows.groupBy("gram").agg(*[F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(c) for f, c in enumerate(_COUNTS)])


def estimates(counts: DataFrame) -> DataFrame:
    """gram, c0 (its count in the first fold) and, for each fold by all others, the estimates e and the context's bucket b."""
    def suffix(symbols: int):
        return F.col("gram").bitwiseAND((1 << (_SYMBOL * symbols)) - 1)

    def context(symbols: int):
        return F.shiftrightunsigned("gram", _SYMBOL).bitwiseAND((1 << (_SYMBOL * symbols)) - 1)

    whole = sum((F.col(c) for c in _COUNTS[1:]), F.col(_COUNTS[0]))
    df = counts.select("gram", "c0", *[(whole - F.col(c)).alias(f"x{f}") for f, c in enumerate(_COUNTS)])
    grown = df
    sums = lambda name: [F.sum(f"x{f}").alias(f"{name}_{f}") for f in range(FOLDS)]
    for k in range(1, ORDER + 1):
        if k < ORDER:
            tops = df.groupBy(suffix(k).alias(f"_s{k}")).agg(*sums(f"n{k}"))
            grown = grown.join(tops, suffix(k) == F.col(f"_s{k}")).drop(f"_s{k}")
        below = df.groupBy(context(k - 1).alias(f"_c{k}")).agg(*sums(f"m{k}"))
        grown = grown.join(below, context(k - 1) == F.col(f"_c{k}")).drop(f"_c{k}")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    bucket = lambda c: F.when(F.col(c) > 0, F.least(F.lit(BUCKETS - 1), F.floor(F.log2(F.col(c).cast("double") + 0.5)) + 1)).otherwise(0).cast("int")
    made = []
    for f in range(FOLDS):
        made.append(F.array(F.lit(1 / 256.0), *[ratio(f"n{k}_{f}" if k < ORDER else f"x{f}", f"m{k}_{f}") for k in range(1, ORDER + 1)]).alias(f"e{f}"))
        made.append(bucket(f"m{ORDER}_{f}").alias(f"b{f}"))
    return grown.select("gram", "c0", *made)


def _mixed(weights: np.ndarray, bucket: str, estimate: str):
    table = F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in weights])
    row = F.get(table, F.col(bucket))
    return [F.get(row, F.lit(k)) * F.get(F.col(estimate), F.lit(k)) for k in range(ORDER + 1)]


def learn_weights(table: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """[bucket, order 0..5]: EM on the first fold's counts; a bucket without any keeps equal weights."""
    weights = np.full((BUCKETS, ORDER + 1), 1 / (ORDER + 1))
    held = cut(table.filter("c0 > 0").select("c0", "e0", "b0"), "held")
    for _ in range(rounds):
        rows = held.select("b0", "c0", F.array(*_mixed(weights, "b0", "e0")).alias("p")).withColumn("all", F.expr("aggregate(p, 0D, (a, x) -> a + x)"))
        sums = rows.groupBy("b0").agg(*[F.sum(F.col("c0") * F.get("p", F.lit(k)) / F.col("all")).alias(f"w{k}") for k in range(ORDER + 1)]).collect()  # one row a bucket
        for r in sums:
            w = np.array([r[f"w{k}"] for k in range(ORDER + 1)])
            w /= w.sum()
            w[0] = max(w[0], LEAST)
            weights[r["b0"]] = w / w.sum()
    return weights


def log_probabilities(docs: DataFrame) -> DataFrame:
    """(gram, lp0, lp1, ...): of each 5-gram the natural log-probability of its last byte after its context, for each fold by all others."""
    table = cut(estimates(cut(gram_counts(docs), "grams")), "estimates")
    weights = learn_weights(table)
    mixed = [_mixed(weights, f"b{f}", f"e{f}") for f in range(FOLDS)]
    return table.select("gram", *[F.log(sum(parts[1:], parts[0])).cast("float").alias(f"lp{f}") for f, parts in enumerate(mixed)])


def hash_table(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Slots of an open-addressing table at most half full (0 is free), the index of their n-grams, and the shift to a slot."""
    bits = max(4, int(2 * len(gram)).bit_length())
    keys, values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
    shift, mask = 64 - bits, (1 << bits) - 1
    slot, todo = (gram * _SLOT >> np.uint64(shift)).astype(np.int64), np.arange(len(gram))
    while len(todo):
        free = keys[slot] == 0
        at, first = np.unique(slot[free], return_index=True)
        won = todo[free][first]
        keys[at], values[at] = gram[won], won
        left = keys[slot] != gram[todo]
        todo, slot = todo[left], slot[left]
        slot = np.where(keys[slot] != 0, (slot + 1) & mask, slot)
    return keys, values, shift


def look_up(table: tuple[np.ndarray, np.ndarray, int], gram: np.ndarray) -> np.ndarray:
    keys, values, shift = table
    slot = (gram * _SLOT >> np.uint64(shift)).astype(np.int64)
    out = values[slot]
    todo = np.flatnonzero(keys[slot] != gram)
    at = slot[todo]
    while len(todo):
        at = (at + 1) & (len(keys) - 1)
        out[todo] = values[at]
        off = keys[at] != gram[todo]
        todo, at = todo[off], at[off]
    return out


def _in_blocks(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            each = np.asarray(batch.column(1).fill_null("").cast(pa.large_binary()).to_numpy(zero_copy_only=False), object)
            ends = size + np.cumsum([len(x) for x in each])
            yield pa.record_batch([*batch.columns, pa.array(number + ends // block)], [*batch.schema.names, "block"])
            size = int(ends[-1]) if len(ends) else size

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct n-grams of each block, which come in their order."""
    now, parts = None, []

    def batch_of():
        gram = np.unique(np.concatenate(parts))
        return pa.record_batch([pa.array(np.full(len(gram), now)), pa.array(gram.view(np.int64))], ["block", "gram"])

    for batch in batches:
        block = np.asarray(batch.column(1))
        for i, j, data, offsets in byte_chunks(batch.column(0)):
            for own in np.unique(block[i:j]).tolist():
                if own != now and parts:
                    yield batch_of()
                    parts = []
                now = own
                rows = np.flatnonzero(block[i:j] == own)
                low, high = rows[0], rows[-1] + 1
                part = slice(offsets[low], offsets[high])
                parts.append(np.unique(ngrams(data[part], offsets[low : high + 1] - offsets[low])))
                if sum(map(len, parts)) > _EMIT:
                    parts = [np.unique(np.concatenate(parts))]
    if parts:
        yield batch_of()


def _scored(texts: pa.Table, model: pa.Table) -> pa.Table:
    gram = model.column("gram").to_numpy().view(np.uint64)
    value = np.stack([model.column(f"lp{f}").to_numpy() for f in range(FOLDS)])
    table = hash_table(gram)
    text = texts.column("text").combine_chunks()
    fold = texts.column("fold").to_numpy()
    size, total = np.zeros(len(text), np.int64), np.zeros(len(text))
    for i, j, data, offsets in byte_chunks(text):
        size[i:j] = np.diff(offsets)
        full = np.flatnonzero(size[i:j])
        if len(full):
            each = value[np.repeat(fold[i:j], size[i:j]), look_up(table, ngrams(data, offsets))].astype(np.float64)
            total[i + full] = np.add.reduceat(each, offsets[full])
    return pa.table([texts.column("doc_id"), pa.array(size), pa.array(total)], ["doc_id", "bytes", "log_prob"])


def lm_scores(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, bytes, log_prob and bits_per_byte of every row, by the model of the other folds of docs."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    model = cut(log_probabilities(docs), "model")
    held = cut(folded(docs).mapInArrow(_in_blocks(block), f"doc_id {kind}, text string, fold int, block long"), "blocks")
    asked = held.select("text", "block").mapInArrow(_asked, "block long, gram long").distinct()
    answers = asked.join(model, "gram")
    scored = held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored, f"doc_id {kind}, bytes long, log_prob double")
    return scored.select("doc_id", "bytes", F.round("log_prob", 4).alias("log_prob"), F.round(F.when(F.col("bytes") > 0, F.col("log_prob") / F.col("bytes") / -math.log(2)), 6).alias("bits_per_byte"))
