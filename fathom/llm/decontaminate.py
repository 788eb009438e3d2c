"""Operator 5: passages of benchmark items in training documents.

Every word 3-gram of an item seeds the search; around every seed hit the item is aligned with the
passage by Smith-Waterman over words, so paraphrased or edited copies score by what still agrees.

Plan: one pass over the texts finds the seeds (numpy over Arrow batches) and aligns on the spot, so no
text is shuffled. Common 3-grams seed too: before the alignment only windows are left out that have too
few of the item's words to reach the threshold, which loses nothing. What is broadcast is the benchmark's
own n-grams and words, never corpus data; past MOST_BROADCAST n-grams the same seeds are found by shuffle
joins and only candidate texts move.

Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased. The score is
Smith-Waterman's best local alignment (match 2, mismatch -1, gap -1) over the item's own best, 2 a word.

Defined results: null or wordless texts and items match nothing; an item of fewer than 3 words has no
seed and matches nothing, and so does a passage that has no three words of the item in a row. Of
overlapping passages of one document and item the best is taken, of equal ones the earliest; every
disjoint one is a row. Rows of items with one item_id are items of their own; equal rows give equal
matches once for each document row. Ids may be of any type and null. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.ragged import byte_chunks, chain, first_of_document, mix, ngram_starts, span_hashes, word_spans
from fathom.llm.scratch import cut, small_batches, trimmed

N = 3
THRESHOLD = 0.5
MOST_BROADCAST = 4_000_000
_FILTER = 1 << 22
#: Words of windows that are looked up at a time.
MOST_WORDS = 1 << 20


def words_and_grams(texts: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, words per text, n-gram hashes, their first words, their texts)."""
    for i, j, data, offsets in byte_chunks(pc.utf8_lower(texts)):
        starts, ends, counts = word_spans(data, offsets)
        hashes = span_hashes(data, starts, ends)
        at, doc = ngram_starts(counts, n)
        yield i, j, hashes, counts, chain(hashes, at, n), at, doc


class Seeds:
    """A sorted set of hashes with a bitmap before it."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.bits = np.zeros(_FILTER, bool)
        self.bits[(self.hashes >> np.uint64(40)).astype(np.int64) & (_FILTER - 1)] = True

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where grams are seeds, and which."""
        maybe = np.flatnonzero(self.bits[(grams >> np.uint64(40)).astype(np.int64) & (_FILTER - 1)])
        if not len(maybe) or not len(self.hashes):
            return maybe[:0], maybe[:0]
        at = np.minimum(np.searchsorted(self.hashes, grams[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == grams[maybe]
        return maybe[hit], at[hit]


def align(passages: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """[score, first word, end word) of each pair's best local alignment, of the earliest end on ties."""

    def best(rows: list[np.ndarray], columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        width, height = max(map(len, columns)), max(map(len, rows))
        c = np.zeros((len(columns), width), np.uint64)
        r = np.ones((len(rows), height), np.uint64)
        for k, (x, y) in enumerate(zip(rows, columns)):
            r[k, : len(x)], c[k, : len(y)] = x, y
        inside = np.arange(width) < np.array([len(y) for y in columns])[:, None]
        step = np.arange(width, dtype=np.int32)
        h, top = np.zeros((len(rows), width), np.int32), np.zeros((len(rows), width), np.int32)
        for k in range(height):
            diagonal = np.zeros_like(h)
            diagonal[:, 1:] = h[:, :-1]
            h = np.maximum(np.maximum(diagonal + np.where(c == r[:, k : k + 1], 2, -1), h - 1), 0)
            h = np.maximum(np.maximum.accumulate(h + step, axis=1) - step, 0).astype(np.int32) * inside
            h[k >= np.array([len(x) for x in rows])] = 0
            top = np.maximum(top, h)
        end = top.argmax(axis=1)
        return top[np.arange(len(rows)), end], end + 1

    out = np.zeros((len(items), 3), np.int64)
    order = np.argsort([len(x) + len(y) for x, y in zip(items, passages)], kind="stable")
    i = 0
    while i < len(order):
        cells = len(items[order[i]]) + len(passages[order[i]])
        group = order[i : i + max(1, 200_000 // max(1, cells * 8))]
        i += len(group)
        score, end = best([items[k] for k in group], [passages[k] for k in group])
        # The alignment's start is where the reversed texts' best alignment ends.
        _, back = best([items[k][::-1] for k in group], [passages[k][:e][::-1] for k, e in zip(group, end)])
        out[group] = np.stack([score, end - back, end], axis=1)
    return out


def windows(text: np.ndarray, item: np.ndarray, diagonal: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """(text, item, first word, end word) around seed hits; hits of one text and item whose windows overlap share one."""
    slack = np.ceil(2 * (1 - threshold) * sizes[item]).astype(np.int64)  # a passage of more gaps is below the threshold
    low, high = np.maximum(diagonal - slack, 0), np.minimum(diagonal + sizes[item] + slack, lengths[text])
    order = np.lexsort((low, item, text))
    text, item, low, high = text[order], item[order], low[order], high[order]
    if not len(text):
        return text, item, low, high
    group = np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1])]
    number = np.cumsum(group)
    far = np.int64(1) << np.int64(40)
    reach = np.maximum.accumulate(high + number * far) - number * far
    new = group.copy()
    new[1:] |= low[1:] >= reach[:-1]
    first = np.flatnonzero(new)
    return text[first], item[first], low[first], np.maximum.reduceat(high, first)


class Benchmark:
    """The items as word hashes, and which item has which n-gram where. Null texts have no words."""

    def __init__(self, texts: list[str | None], n: int):
        words, at, grams, first, text = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, _, hashes, counts, g, start, doc in words_and_grams(pa.array(texts, pa.string()), n):
            words.append(hashes), at.append(counts), grams.append(g), text.append(doc + i)
            first.append(start - first_of_document(counts)[doc])
        self.sizes = np.concatenate(at)
        self.words = np.split(np.concatenate(words), np.cumsum(self.sizes)[:-1]) if len(self.sizes) else []
        self.gram, self.first, self.item = np.concatenate(grams), np.concatenate(first), np.concatenate(text)

        own = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.key, self.times = np.unique(self.keys(np.concatenate(words), own), return_counts=True)

    @staticmethod
    def keys(words: np.ndarray, items: np.ndarray) -> np.ndarray:
        return mix(words * np.uint64(0xC2B2AE3D27D4EB4F) + items.astype(np.uint64))


def promising(word: np.ndarray, begin: np.ndarray, text: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray, bench: Benchmark, threshold: float) -> np.ndarray:
    """Index of the windows that have enough of their item's words: fewer matches than threshold x size never reach the threshold."""
    size, keep = high - low, []
    part = np.cumsum(size) // MOST_WORDS
    for now in np.split(np.arange(len(text)), np.flatnonzero(np.diff(part)) + 1):
        n = size[now]
        window = np.repeat(np.arange(len(now)), n)
        at = np.repeat(begin[text[now]] + low[now] - np.cumsum(n) + n, n) + np.arange(n.sum())
        keys = bench.keys(word[at], item[now][window])
        slot = np.minimum(np.searchsorted(bench.key, keys), len(bench.key) - 1)
        has = np.unique((window * len(bench.key) + slot)[bench.key[slot] == keys])
        most = np.bincount(has // len(bench.key), bench.times[has % len(bench.key)], len(now))
        keep.append(now[most >= threshold * bench.sizes[item[now]] - 1e-9])
    return np.concatenate(keep)


def passages(word: np.ndarray, counts: np.ndarray, text: np.ndarray, item: np.ndarray, diagonal: np.ndarray, bench: Benchmark, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, end word) around seed hits: each window's best passage, where it reaches the threshold, and so on before and after it."""
    text, item, low, high = windows(text, item, diagonal, bench.sizes, counts, threshold)
    begin = first_of_document(counts)
    while len(text):
        good = promising(word, begin, text, item, low, high, bench, threshold)
        text, item, low, high = text[good], item[good], low[good], high[good]
        found = align([word[begin[t] + a : begin[t] + b] for t, a, b in zip(text, low, high)], [bench.words[k] for k in item])
        share = found[:, 0] / (2 * bench.sizes[item])
        hit = (share >= threshold) & (found[:, 0] > 0)
        text, item, low, high, share, start, end = text[hit], item[hit], low[hit], high[hit], share[hit], low[hit] + found[hit, 1], low[hit] + found[hit, 2]
        yield from zip(text.tolist(), item.tolist(), share.round(6).tolist(), start.tolist(), end.tolist())
        text, item, low, high = np.r_[text, text], np.r_[item, item], np.r_[low, end], np.r_[start, high]


def matches_of(word: np.ndarray, counts: np.ndarray, hit_text: np.ndarray, hit_word: np.ndarray, hit_row: np.ndarray, bench: Benchmark, threshold: float) -> dict[int, list[dict]]:
    """Matches by text; hit_row says which n-gram of the benchmark was hit at which word of which text."""
    out: dict[int, list[dict]] = {}
    for t, k, share, start, end in passages(word, counts, hit_text, bench.item[hit_row], hit_word - bench.first[hit_row], bench, threshold):
        out.setdefault(t, []).append({"item": k, "score": share, "first_word": start, "end_word": end})
    return {t: sorted(found, key=lambda m: (m["item"], m["first_word"])) for t, found in out.items()}


def matcher(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD):
    """A column of (item_id, score, first_word, end_word) lists for docs' texts; the broadcast way."""
    small_batches(docs.sparkSession)
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).orderBy("item_id", "text").toArrow()
    bench, ids = Benchmark(items.column("text").to_pylist(), n), items.column("item_id").combine_chunks()
    held = docs.sparkSession.sparkContext.broadcast((vars(bench), ids))  # plain arrays: workers need no import to read them

    @F.arrow_udf(f"array<struct<item_id: {_kind(benchmark, 'item_id')}, score: double, first_word: int, end_word: int>>")
    @trimmed
    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bench = Benchmark.__new__(Benchmark)
        vars(bench).update(held.value[0])
        ids = held.value[1]
        by_gram = np.argsort(bench.gram, kind="stable")
        seeds = Seeds(bench.gram[by_gram])
        first = np.searchsorted(bench.gram[by_gram], seeds.hashes)
        times = np.diff(np.r_[first, len(by_gram)])
        for batch in batches:
            found: dict[int, list[dict]] = {}
            for i, _, word, counts, grams, at, doc in words_and_grams(batch, n):
                where, which = seeds.find(grams)
                if len(where):
                    many = times[which]
                    row = by_gram[np.repeat(first[which] - np.cumsum(many) + many, many) + np.arange(many.sum())]
                    where = np.repeat(where, many)
                    hit = at[where] - first_of_document(counts)[doc[where]]
                    found |= {t + i: m for t, m in matches_of(word, counts, doc[where], hit, row, bench, threshold).items()}
            rows = [m for k in range(len(batch)) for m in found.get(k, ())]
            size = np.array([len(found.get(k, ())) for k in range(len(batch))], np.int64)
            item = ids.take(pa.array([m["item"] for m in rows], pa.int64()))
            fields = [pa.array([m[c] for m in rows], t) for c, t in (("score", pa.float64()), ("first_word", pa.int32()), ("end_word", pa.int32()))]
            yield pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.StructArray.from_arrays([item, *fields], ["item_id", "score", "first_word", "end_word"]))

    return match(docs["text"].cast("string"))


def _kind(table: DataFrame, column: str) -> str:
    return table.schema[column].dataType.simpleString()


def _by_joins(docs: DataFrame, benchmark: DataFrame, n: int, threshold: float) -> DataFrame:
    """(doc_id, tag, item_id, score, first_word, end_word) without a broadcast; tag is the text's hash."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, counts, g, at, doc in words_and_grams(batch.column(2), n):
                rows = pa.array(doc + i)
                word = at - first_of_document(counts)[doc]
                yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(g.view(np.int64)), pa.array(word, pa.int32())], ["id", "tag", "gram", "word"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("doc_id", "tag", "item_id", "score", "first_word", "end_word")}
            for r in batch.to_pylist():
                bench = Benchmark([r["item_text"]], n)
                for _, _, word, counts, *_ in words_and_grams(pa.array([r["text"]], pa.string()), n):
                    diagonal = np.array(r["diagonals"], np.int64)
                    zero = np.zeros(len(diagonal), np.int64)
                    for _, _, share, start, end in passages(word, counts, zero, zero, diagonal, bench, threshold):
                        for k, v in zip(out, (r["id"], r["tag"], r["item_id"], share, start, end)):
                            out[k].append(v)
            types = [batch.schema.field("id").type, pa.int64(), batch.schema.field("item_id").type, pa.float64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))

    small_batches(docs.sparkSession)
    kind, item_kind = _kind(docs, "doc_id"), _kind(benchmark, "item_id")
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("tag"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").alias("id"), F.xxhash64("text").alias("tag"), F.col("text").cast("string").alias("text"))
    own = cut(items.mapInArrow(trimmed(grams), f"id {item_kind}, tag long, gram long, word int"), "items")
    seeds = own.select(F.col("id").alias("item_id"), F.col("tag").alias("item_tag"), "gram", F.col("word").alias("item_word"))
    pairs = texts.mapInArrow(trimmed(grams), f"id {kind}, tag long, gram long, word int").join(seeds, "gram").groupBy("id", "tag", "item_id", "item_tag").agg(F.collect_set(F.col("word") - F.col("item_word")).alias("diagonals"))
    p, t, q = pairs.alias("p"), texts.alias("t"), items.alias("q")
    with_text = p.join(t, F.col("p.id").eqNullSafe(F.col("t.id")) & (F.col("p.tag") == F.col("t.tag"))).join(q, F.col("p.item_id").eqNullSafe(F.col("q.id")) & (F.col("p.item_tag") == F.col("q.tag")))
    return with_text.select("p.id", "p.tag", "p.item_id", "p.diagonals", "t.text", F.col("q.text").alias("item_text")).mapInArrow(trimmed(scored), f"doc_id {kind}, tag long, item_id {item_kind}, score double, first_word int, end_word int")


def fits(benchmark: DataFrame, most: int = MOST_BROADCAST) -> bool:
    """Whether the items' words are few enough to broadcast."""
    return (benchmark.agg(F.sum(F.size(F.split("text", "\\s+")))).first()[0] or 0) <= most


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word of every passage that scores the threshold or more and lies apart from a better one."""
    if not fits(benchmark, most_broadcast):
        return _by_joins(docs, benchmark, n, threshold).drop("tag")
    found = docs.select("doc_id", F.explode(matcher(docs, benchmark, n, threshold)).alias("m"))
    return found.select("doc_id", "m.item_id", "m.score", "m.first_word", "m.end_word")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """docs without the rows that contain a passage of the benchmark."""
    if fits(benchmark, most_broadcast):
        return docs.filter(F.size(matcher(docs, benchmark, n, threshold)) == 0)
    bad = cut(_by_joins(docs, benchmark, n, threshold).select(F.col("doc_id").alias("__fathom_id"), F.col("tag").alias("__fathom_tag")).distinct(), "leaks")
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("__fathom_id")) & (F.xxhash64(docs["text"]) == F.col("__fathom_tag")), "left_anti")
