"""Operator 3: maximal passages of at least MIN_WORDS words that occur more than once.

Prefix-partitioned suffix trees over words. A repeat of MIN_WORDS = ANCHOR + SPREAD - 1 words always holds,
in every copy at the same place, the least hash among SPREAD consecutive ANCHOR-word prefixes (an anchor);
so suffixes are taken at anchors only, with the SPREAD words before them. Anchors whose prefix occurs with
two different chunks of text before it can begin a repeat; where all copies go on to the left alike, an
earlier anchor has the same repeats. The suffixes are partitioned by their prefix. A partition too large for
memory is split by longer prefixes: all its members share one passage, and repeats longer to the right (or,
of that right end, longer to the left) lie in the partitions of the next word. In a memory-sized partition
the sorted suffixes and their common prefixes form the subtree; its internal nodes are visited from the
deepest up, and each member's best agreement to the left within a node gives a maximal repeat. Of the right
symbols only neighbours are compared, as they arrive, and none are kept: memory doesn't depend on how far
suffixes are read, so large clusters of long near copies aren't split one edit a round. Suffixes that
agree as far as they were read are read on, GROWTH times further each round, under a prefix of that length.

A run of equal words is one symbol with its length, and only the anchors of its first and last MIN_WORDS
words count, so texts of one word repeated cost no more than others. Period 2 and more has no such relief.

Result: of each document the repeats that no longer repeat of it contains. A row is an occurrence of a
maximal repeat (longer on either side it would occur fewer times), with the number of its occurrences in
all texts (overlapping ones and those in one text too) and the least doc_id that has it.

Plan: a pass over the texts emits (prefix hash, document, place, chunk bits) of about one word in 13; a
bit-or by prefix tells which begin repeats; texts that have such places move once, by key; their
surroundings, 32 bits a word, are partitioned and sorted by Spark before the trees are built over Arrow batches.

Words are runs of bytes other than ASCII white space, compared exactly, by 64-bit hashes of prefixes and
31-bit hashes of words.

Defined results: null, empty and shorter texts have no passages. Every row is an occurrence, repeated rows
too, and such rows share one result row. doc_id may be of any type that has an order; rows with a null
doc_id take part, their passages carry a null, and original_doc_id is the least id that isn't null. Other
columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fathom.llm.ragged import NONSPACE, byte_chunks, chain, first_of_document, mix, ngram_starts, span_hashes, word_spans
from fathom.llm.scratch import cut, settle, small_batches, trimmed

MIN_WORDS, ANCHOR = 50, 26
#: Most bytes of a partition whose tree is built in memory: its left symbols and a few numbers a suffix.
GROUP = 16 << 20
#: Symbols of a suffix that are read in the first round, and how much further each next round reads.
FIRST, GROWTH = 100, 4
#: Symbols of a batch of trees, and those of neighbours that are compared at a time.
BATCH, SLICE = 4_000_000, 1 << 18
_MARK = np.uint32(1 << 31)
_LOW = (1 << 31) - 1


class Runs:
    """The texts of a chunk as words, and as runs of equal words: a symbol a run, and one more, _MARK | size, for a run of several."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, self.counts = word_spans(data, offsets, NONSPACE)
        self.words = span_hashes(data, starts, ends)
        n = len(self.words)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.begin = first_of_document(self.counts)
        new = np.ones(n, bool)
        new[1:] = (self.words[1:] != self.words[:-1]) | (self.doc[1:] != self.doc[:-1])
        self.first, self.run = np.flatnonzero(new), np.cumsum(new) - 1
        self.size = np.diff(np.r_[self.first, n])

    def symbols(self) -> None:
        """Forward and backward symbol streams, and where runs and documents lie in them."""
        self.word = (self.words[self.first] >> np.uint64(33)).astype(np.uint32)
        wide = 1 + (self.size > 1)
        self.total = int(wide.sum())
        self.at = np.cumsum(wide) - wide
        self.stream, self.back = np.zeros(self.total + 1, np.uint32), np.zeros(self.total + 1, np.uint32)
        many = self.size > 1
        mark = _MARK | self.size[many].astype(np.uint32)
        self.stream[self.at], self.stream[self.at[many] + 1] = self.word, mark
        reverse = self.total - self.at - wide
        self.back[reverse], self.back[reverse[many] + 1] = self.word, mark
        each = np.bincount(self.doc[self.first], wide, len(self.counts)).astype(np.int64)
        self.doc_end = np.cumsum(each)
        self.doc_start = self.doc_end - each
        self.before = np.r_[0, np.cumsum(weights(self.stream[: self.total]))]


def weights(symbols: np.ndarray) -> np.ndarray:
    """Words that a symbol stands for."""
    return np.where(symbols >= _MARK, (symbols & np.uint32(_LOW)).astype(np.int64) - 1, 1)


def anchors(t: Runs, anchor: int, spread: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word index, prefix hash, hash of the chunk since the anchor before, and whether it is a text's first: of every window's least prefix.

    Of a run longer than anchor + spread - 1 words only so many stand in the windows. Anchors there are given
    as counted from the run's start and from its end.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    cap = anchor + spread - 1
    inside = np.arange(len(t.words)) - t.first[t.run]
    real = np.flatnonzero(inside < cap)
    words, own = t.words[real], t.doc[real]
    at, doc = ngram_starts(np.bincount(own, minlength=len(t.counts)), anchor)
    hashes = chain(words, at, anchor)
    n = len(hashes)
    if n < spread:
        return none
    # 40 bits of hash with the place below them: the least value also says where it is
    value = (hashes >> np.uint64(24) << np.uint64(24)) | (np.arange(n, dtype=np.uint64) & np.uint64((1 << 24) - 1))
    width, least = 1, value
    while width * 2 <= spread:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    windows = n - spread + 1
    least = np.minimum(least[:windows], least[spread - width : spread - width + windows])
    base = np.flatnonzero(doc[:windows] == doc[spread - 1 :])
    if not len(base):
        return none
    place = (base & ~np.int64((1 << 24) - 1)) + (least[base] & np.uint64((1 << 24) - 1)).astype(np.int64)
    place = np.unique(np.where(place < base, place + (1 << 24), place))
    capped = at[place]
    first = np.r_[True, doc[place][1:] != doc[place][:-1]]
    chunk = span_hashes(words, np.where(first, capped, np.r_[0, capped[:-1]]), capped)
    index, run = real[capped], t.run[real[capped]]
    long = t.size[run] > cap
    from_start = ~long | (inside[index] + anchor <= cap)
    # A long run overlaps itself from its first and second word.
    own = np.repeat(t.first[t.size > cap], 2)
    pure = chain(np.repeat(t.words[own][:, None], anchor, axis=1).ravel(), np.arange(len(own)) * anchor, anchor)
    own[1::2] += 1
    index = np.r_[index[from_start], (index + t.size[run] - cap)[long], own]
    return index, *(np.r_[x[from_start], x[long], y] for x, y in ((hashes[place], pure), (chunk, t.words[own]), (first, np.ones(len(own), bool))))


def _anchor_rows(anchor: int, spread: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = np.asarray(batch.column(1)).astype(np.uint64)
            for i, _, data, offsets in byte_chunks(batch.column(2)):
                t = Runs(data, offsets)
                index, prefix, chunk, first = anchors(t, anchor, spread)
                doc = t.doc[index]
                # What is before a text is like nothing else.
                chunk = np.where(first, mix((number[i + doc] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + index.astype(np.uint64)), chunk)
                low = (chunk & np.uint64(_LOW)).astype(np.int64)
                bits = low | (low ^ _LOW) << 32
                yield pa.record_batch([pa.array(prefix.view(np.int64)), batch.column(0).take(pa.array(doc + i)), pa.array(index - t.begin[doc], pa.int32()), pa.array(bits)], ["g", "key", "at", "bits"])

    return run


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


def _binary(symbols: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(4 * size)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(symbols.astype(">u4").tobytes())])


def suffixes(t: Runs, index: np.ndarray, skip: np.ndarray, anchor: int, spread: int, width: int) -> tuple:
    """Of each word index: partition, words of the skipped symbols, left and right symbols with their numbers, whether the right goes on, and whether the left is all there is."""
    t.symbols()
    doc, run = t.doc[index], t.run[index]
    inside = index - t.first[run]
    rest = t.size[run] - inside
    start = t.at[run] + ((inside > 0) & (rest == 1))
    begin = start + skip
    end = np.minimum(begin + width, t.doc_end[doc])
    end += (end < t.doc_end[doc]) & (t.stream[end] >= _MARK)  # never between a word and its mark
    size = end - begin
    right = t.stream[_ragged(begin, size)]
    row = np.cumsum(size) - size
    now = np.flatnonzero((skip == 0) & (size > 0))
    right[row[now]] = t.word[run[now]]
    part = (inside > 0) & (rest > 1)
    now = np.flatnonzero((skip == 0) & part & (size > 1))
    right[row[now] + 1] = _MARK | rest[now].astype(np.uint32)
    words = np.where(skip > 0, t.before[begin] - t.before[t.at[run]] - inside, 0)
    second = np.where(part, _MARK | rest.astype(np.uint32), t.stream[np.minimum(start + 1, t.total)]).astype(np.uint64)
    read = np.minimum(start + 2, begin)
    deep = mix(t.word[run].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + second * np.uint64(0xC2B2AE3D27D4EB4F) + span_hashes(t.stream[: t.total], read, np.maximum(begin, read)))
    prefix = np.where(skip > 0, deep, chain(t.words, index, anchor))

    cap = anchor + spread - 1
    capped = np.minimum(t.size, cap)
    sums = np.cumsum(capped) - capped
    have = sums[run] + np.minimum(inside, cap)
    opening = sums[t.run[t.begin[doc]]]
    bound = have - opening <= spread
    farthest = np.maximum(np.searchsorted(sums, have - spread, "right") - 1, 0)
    stop = t.total - np.where(bound, t.doc_start[doc], t.at[farthest])
    first = t.total - t.at[run] - np.minimum(inside, 2)
    first = np.where(inside > 1, t.total - t.at[run] - 1 - (t.size[run] > 1), first)
    length = stop - first
    left = t.back[_ragged(first, length)]
    row = np.cumsum(length) - length
    now = np.flatnonzero(inside > 0)
    left[row[now]] = t.word[run[now]]
    now = np.flatnonzero(inside > 1)
    left[row[now] + 1] = _MARK | inside[now].astype(np.uint32)
    return prefix, words, left, length, right, size, end < t.doc_end[doc], bound


def _suffix_rows(anchor: int, spread: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, lists = batch.column(0), batch.column(1), batch.column(3)
            edge = np.asarray(lists.offsets)
            place, skips = (np.asarray(lists.values.field(k)).astype(np.int64) for k in range(2))
            for i, j, data, offsets in byte_chunks(batch.column(2)):
                t = Runs(data, offsets)
                doc = np.repeat(np.arange(j - i), np.diff(edge[i : j + 1]))
                at, skip = place[edge[i] : edge[j]], skips[edge[i] : edge[j]]
                keep = at + anchor <= t.counts[doc]
                doc, at, skip = doc[keep], at[keep], skip[keep]
                if not len(doc):
                    continue
                prefix, words, left, length, right, size, goes_on, bound = suffixes(t, t.begin[doc] + at, skip, anchor, spread, width)
                rows = pa.array(doc + i)
                yield pa.record_batch(
                    [pa.array(prefix.view(np.int64)), ids.take(rows), keys.take(rows), pa.array(at, pa.int32()), pa.array(skip, pa.int32()), pa.array(words, pa.int32()), _binary(left, length), _binary(right, size), pa.array(goes_on), pa.array(bound)],
                    ["g", "id", "key", "at", "skip", "lo", "left", "right", "goes_on", "bound"],
                )

    return run


class Symbols:
    """Ragged symbol rows as a matrix, zero beyond their ends."""

    def __init__(self, values: pa.Array):
        n = len(values)
        edge = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + n + 1] if n else np.zeros(1, np.int32)
        self.size = (np.diff(edge) // 4).astype(np.int64)
        self.cell = np.zeros((n, max(1, int(self.size.max(initial=0)))), np.uint32)
        raw = values.buffers()[2]
        if raw is not None and n:
            self.cell[np.repeat(np.arange(n), self.size), _ragged(np.zeros(n, np.int64), self.size)] = np.frombuffer(raw, np.uint8)[edge[0] : edge[-1]].view(">u4")
        self.words = np.cumsum(weights(self.cell), axis=1)

    def common(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and words on which rows a and b agree from their start."""
        differ = self.cell[a] != self.cell[b]
        at = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), differ.shape[1]), np.minimum(self.size[a], self.size[b]))
        words = np.where(at > 0, self.words[a, np.maximum(at - 1, 0)], 0)
        here = np.minimum(at, differ.shape[1] - 1)
        x, y = self.cell[a, here], self.cell[b, here]
        both = (at < self.size[a]) & (at < self.size[b]) & (x >= _MARK) & (y >= _MARK)
        return at, words + np.where(both, np.minimum(x, y).astype(np.int64) - int(_MARK) - 1, 0)

    def order(self) -> np.ndarray:
        return np.lexsort(np.vstack([self.size, self.cell.T[::-1]]))


def neighbours(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of each ragged row; and symbols and words on which each row but the first agrees with the one before, from their start."""
    edge = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    size, data = np.diff(edge) // 4, values.buffers()[2]
    at, words = np.minimum(size[:-1], size[1:]), np.zeros(len(size) - 1, np.int64)
    i = 0
    while i < len(at):
        j = min(len(at), max(i + 1, int(np.searchsorted(edge, edge[i] + 4 * SLICE, "right")) - 2))
        raw = np.frombuffer(data, np.uint8)[edge[i] : edge[j + 1]].view(">u4").astype(np.uint32) if edge[j + 1] > edge[i] else np.zeros(1, np.uint32)
        begin, short = (edge[i : j + 1] - edge[i]) // 4, at[i:j].copy()
        differ = np.flatnonzero(raw[_ragged(begin[:-1], short)] != raw[_ragged(begin[1:], short)])
        before = np.cumsum(short) - short
        pair = np.searchsorted(np.cumsum(short), differ, "right")
        new = np.r_[True, pair[1:] != pair[:-1]] if len(pair) else np.zeros(0, bool)
        at[i + pair[new]] = differ[new] - before[pair[new]]
        sums = np.r_[0, np.cumsum(weights(raw))]
        x, y = (np.minimum(b + at[i:j], len(raw) - 1) for b in (begin[:-1], begin[1:]))
        both = (at[i:j] < short) & (raw[x] >= _MARK) & (raw[y] >= _MARK)
        words[i:j] = sums[begin[:-1] + at[i:j]] - sums[begin[:-1]] + np.where(both, np.minimum(raw[x], raw[y]).astype(np.int64) - int(_MARK) - 1, 0)
        i = j
    return size, at, words


def nodes(shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row of the node of each pair of neighbours: as far as neighbours share at least as much."""
    n = len(shared)
    low, high, values = np.zeros(n, np.int64), np.full(n, n, np.int64), shared.tolist()
    stack: list[int] = []
    for k, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            high[stack.pop()] = k
        # equal neighbours above the same lower one are one node
        low[k] = low[stack[-1]] if stack and values[stack[-1]] == v else (stack[-1] + 1 if stack else 0)
        if stack and values[stack[-1]] == v:
            high[stack[-1]] = -1
            stack.pop()
        stack.append(k)
    return low, high


def tree_repeats(shared: np.ndarray, left: Symbols, ids: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """Of suffixes sorted by group and right symbols, from the words that neighbours share to the right: row, words to the left and to the right, members and least id of each node that shows a row more to its left than deeper nodes do."""
    n = len(ids)
    out = [np.zeros((0, 5), np.int64)]
    if n > 1:
        low, high = nodes(shared)
        rank = np.empty(n, np.int64)
        rank[left.order()] = np.arange(n)
        top = np.full(n, -1, np.int64)
        heads = np.flatnonzero((shared > 0) & (high >= 0))
        heads = heads[np.argsort(-shared[heads], kind="stable")]
        for part in np.split(heads, np.flatnonzero(np.diff(shared[heads])) + 1) if len(heads) else []:
            depth = int(shared[part[0]])
            size = high[part] - low[part] + 1
            member = _ragged(low[part], size)
            node = np.repeat(np.arange(len(part)), size)
            order = np.lexsort((rank[member], node))
            member = member[order]
            agree = np.where(node[1:] == node[:-1], left.common(member[:-1], member[1:])[1], -1)
            best = np.maximum(np.r_[-1, agree], np.r_[agree, -1])
            fresh = np.flatnonzero((best > top[member]) & (best + depth >= min_words))
            for value in np.unique(best[fresh]):
                mine = fresh[best[fresh] == value]
                family = np.r_[0, np.cumsum(agree < value)]
                first = np.flatnonzero(np.r_[True, agree < value])
                least, count = np.minimum.reduceat(ids[member], first), np.diff(np.r_[first, len(member)])
                own = family[mine]
                out.append(np.stack([member[mine], np.full(len(mine), value), np.full(len(mine), depth), count[own], least[own]], axis=1))
            top[member] = np.maximum(top[member], best)
    return tuple(np.concatenate(out).T)


def _ranked(ids: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers in the order of the ids, the last for null; and the ids by number."""
    own = pc.unique(ids.drop_null())
    own = own.take(pc.sort_indices(own))
    number = pc.index_in(ids, own).fill_null(len(own))
    return np.asarray(number).astype(np.int64), pa.concat_arrays([own, pa.nulls(1, own.type)])


def _tree_rows(min_words: int):
    def finish(table: pa.Table) -> pa.RecordBatch:
        col = {c: table.column(c).combine_chunks() for c in table.column_names}
        at, shared = (np.asarray(col[c]).astype(np.int64) for c in ("at", "shared"))
        left = Symbols(col["left"])
        ids, named = _ranked(col["id"])
        row, before, after, copies, least = tree_repeats(shared[1:], left, ids, min_words)
        # Equal suffixes that go on are read further, unless all go on to the left alike.
        n = len(at)
        equal = col["equal"].to_numpy(zero_copy_only=False).astype(bool)[1:]
        order = left.order()
        kind = np.empty(n, np.int64)
        kind[order] = np.r_[0, np.cumsum((left.cell[order[1:]] != left.cell[order[:-1]]).any(axis=1) | (left.size[order[1:]] != left.size[order[:-1]]))]
        first = np.flatnonzero(np.r_[True, ~equal])
        family = np.r_[0, np.cumsum(~equal)]
        goes_on, bound = np.asarray(col["goes_on"].to_numpy(zero_copy_only=False)).astype(bool), np.asarray(col["bound"].to_numpy(zero_copy_only=False)).astype(bool)
        several = np.add.reduceat(goes_on.astype(np.int64), first) > 1
        diverse = (np.minimum.reduceat(kind, first) != np.maximum.reduceat(kind, first)) | np.maximum.reduceat(bound, first)
        more = np.flatnonzero(goes_on & (several & diverse)[family])
        rows = pa.array(np.r_[row, more])
        blank = pa.nulls(len(more), pa.int32())
        return pa.record_batch(
            [
                col["id"].take(rows), col["key"].take(rows), col["at"].take(rows), pa.concat_arrays([pa.array(at[row] - before, pa.int32()), blank]), pa.concat_arrays([pa.array(at[row] + after, pa.int32()), blank]),
                pa.array(np.r_[copies, np.zeros(len(more), np.int64)]), named.take(pa.array(np.r_[least, np.full(len(more), len(named) - 1)])), pa.concat_arrays([pa.nulls(len(row), pa.int32()), pa.array((np.asarray(col["skip"]).astype(np.int64) + np.asarray(col["size"]))[more], pa.int32())]),
            ],
            ["id", "key", "at", "first_word", "end_word", "copies", "original", "more"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        rows = widest = 0
        last, last_group = pa.array([b""], pa.binary()), None
        for batch in batches:
            if not len(batch):
                continue
            # Each row's agreement with the one before takes the place of its right symbols.
            group, lo, right = np.asarray(batch.column("g")), np.asarray(batch.column("lo")).astype(np.int64), batch.column("right")
            size, common, words = neighbours(pa.concat_arrays([last, right]))
            same = np.r_[last_group is not None and group[0] == last_group, group[1:] == group[:-1]]
            last, last_group = pa.array([right[-1].as_py()], pa.binary()), group[-1]
            kept = batch.select(["g", "id", "key", "at", "skip", "left", "goes_on", "bound"])
            equal = same & (size[1:] == size[:-1]) & (common == size[1:])
            waiting.append(pa.record_batch([*kept.columns, pa.array(size[1:]), pa.array(np.where(same, words + lo, -1)), pa.array(equal)], [*kept.schema.names, "size", "shared", "equal"]))
            rows, widest = rows + len(batch), max(widest, 32 + 2 * (pc.max(pc.binary_length(batch.column("left"))).as_py() // 4))
            if rows * max(1, widest) >= BATCH:
                table = pa.Table.from_batches(waiting)
                g = np.asarray(table.column("g"))
                whole = int(np.searchsorted(g, g[-1]))  # the last group may go on
                if whole:
                    yield finish(table.slice(0, whole))
                waiting, rows, widest = table.slice(whole).to_batches(), len(table) - whole, 0 if whole else widest
        if waiting:
            yield finish(pa.Table.from_batches(waiting))

    return run


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each large partition, from its least and greatest right and left symbols: what all its members share."""
    for batch in batches:
        both = {}
        for side in ("right", "left"):
            s = Symbols(pa.concat_arrays([batch.column(f"least_{side}"), batch.column(f"most_{side}")]))
            n = len(batch)
            at, words = s.common(np.arange(n), np.arange(n) + n)
            # All members have a mark there if the least one has.
            marked = (at < s.size[:n]) & (s.cell[np.arange(n), np.minimum(at, s.cell.shape[1] - 1)] >= _MARK)
            both[side] = at, words, marked
        r, left = both["right"], both["left"]
        yield pa.record_batch(
            [batch.column("g"), pa.array(4 * r[0], pa.int32()), pa.array(r[1], pa.int32()), pa.array(r[2]), pa.array(4 * left[0], pa.int32()), pa.array(left[1], pa.int32()), pa.array(left[2]), batch.column("members"), batch.column("original")],
            ["g", "right_bytes", "right_words", "right_marked", "left_bytes", "left_words", "left_marked", "members", "original"],
        )


def _partitions(rows: DataFrame, min_words: int, group: int, kind: str) -> list[DataFrame]:
    """The trees' rows of all partitions; large ones are split by longer prefixes until all fit."""
    shape = f"id {kind}, key long, at int, first_word int, end_word int, copies long, original {kind}, more int"
    names = [c.split()[0] for c in shape.split(", ")]
    columns = rows.columns
    trees = lambda some: some.repartition("g").sortWithinPartitions("g", "right").mapInArrow(trimmed(_tree_rows(min_words)), shape)
    done = []
    while True:
        size = F.sum(F.octet_length("left") + 32)
        large = cut(rows.groupBy("g").agg(size.alias("bytes")).filter(F.col("bytes") > group).select("g"), "large")
        if large.isEmpty():
            return done + [trees(rows)]
        big = rows.join(large, "g")
        ends = [f(side).alias(f"{name}_{side}") for side in ("right", "left") for name, f in (("least", F.min), ("most", F.max))]
        facts = big.groupBy("g").agg(F.count("*").alias("members"), F.min("id").alias("original"), *ends)
        shared = cut(facts.mapInArrow(trimmed(_shared_rows), f"g long, right_bytes int, right_words int, right_marked boolean, left_bytes int, left_words int, left_marked boolean, members long, original {kind}"), "shared")
        known = cut(big.join(shared, "g"), "members")
        # Runs of different lengths are no prefixes of each other: they stay together, whatever their number.
        done.append(trees(rows.join(large, "g", "left_anti").unionByName(known.filter("right_marked or (left_marked and length(right) = right_bytes)").select(columns))))
        apart = known.filter("not (right_marked or (left_marked and length(right) = right_bytes))")
        reach = F.col("lo") + F.col("right_words")
        done.append(apart.filter(reach + F.col("left_words") >= min_words).select("id", "key", "at", (F.col("at") - F.col("left_words")).alias("first_word"), (F.col("at") + reach).alias("end_word"), F.col("members").alias("copies"), "original", F.lit(None).cast("int").alias("more")).select(names))
        reads_on = apart.filter("goes_on and length(right) = right_bytes and (bound or length(left) > left_bytes)")
        done.append(reads_on.select("id", "key", "at", *[F.lit(None).cast("int").alias(c) for c in ("first_word", "end_word")], F.lit(0).cast("long").alias("copies"), F.lit(None).cast(kind).alias("original"), F.expr("skip + length(right) div 4").cast("int").alias("more")).select(names))

        def next_prefix(side: str, tag: int):
            marked = F.expr(f"substring({side}, {side}_bytes + 1, 1) >= X'80'")
            return F.xxhash64(F.lit(tag), "g", F.expr(f"substring({side}, 1, {side}_bytes)"), F.when(marked, F.lit(None)).otherwise(F.expr(f"substring({side}, {side}_bytes + 1, 4)")))

        longer = apart.filter("length(right) > right_bytes").withColumn("g", next_prefix("right", 1)).select(columns)
        sideways = apart.filter("length(left) > left_bytes").withColumns({"g": next_prefix("left", 2), "right": F.expr("substring(right, 1, right_bytes)"), "goes_on": F.lit(False)}).select(columns)
        rows = cut(longer.unionByName(sideways), "parts")


def _run_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, offsets in byte_chunks(batch.column(2)):
                t = Runs(data, offsets)
                long = np.flatnonzero(t.size >= min_words)
                doc = t.doc[t.first[long]]
                rows, start = pa.array(doc + i), t.first[long] - t.begin[doc]
                yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(t.words[t.first[long]].view(np.int64)), pa.array(start, pa.int32()), pa.array(start + t.size[long], pa.int32())], ["id", "key", "word", "start", "stop"])

    return run


def _counted_in_runs(spans: DataFrame, held: DataFrame, min_words: int, kind: str) -> DataFrame:
    """spans with the copies of those within a run of one word counted over all runs: a run of n holds n - k + 1 passages of k."""
    runs = cut(held.select("id", "key", "text").mapInArrow(trimmed(_run_rows(min_words)), f"id {kind}, key long, word long, start int, stop int"), "runs")
    lengths = runs.groupBy("word", (F.col("stop") - F.col("start")).alias("n")).agg(F.count("*").alias("c"))
    s, r = spans.alias("s"), runs.distinct().alias("r")
    inside = (F.col("s.key") == F.col("r.key")) & F.col("s.id").eqNullSafe(F.col("r.id")) & (F.col("s.first_word") >= F.col("r.start")) & (F.col("s.end_word") <= F.col("r.stop"))
    marked = cut(s.join(r, inside, "left").select("s.*", "r.word", F.expr("s.end_word - s.first_word").alias("k")), "marked")
    asked = marked.filter("word is not null").select("word", "k").distinct()
    total = asked.join(lengths, "word").filter("n >= k").groupBy("word", "k").agg(F.sum(F.expr("c * (n - k + 1)")).alias("all"))
    return marked.join(total, ["word", "k"], "left").withColumn("copies", F.coalesce("all", "copies")).drop("word", "k", "all")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, anchor: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """doc_id, first_word, end_word, copies and original_doc_id of each maximal repeat of a document that none of its longer ones contains."""
    small_batches(docs.sparkSession)
    spread = min_words - anchor + 1
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).filter(F.length("text") >= 2 * min_words - 1).withColumn("key", F.xxhash64("id", "text"))
    numbered = texts.select("key", F.monotonically_increasing_id().alias("number"), "text")
    found = numbered.mapInArrow(trimmed(_anchor_rows(anchor, spread)), "g long, key long, at int, bits long")
    # One shuffle by prefix, and no table of all anchors: a window gives each anchor its prefix's bits.
    diverse = found.withColumn("all", F.bit_or("bits").over(W.partitionBy("g"))).filter(f"all & shiftright(all, 32) & {_LOW} <> 0")
    places = cut(diverse.groupBy("key").agg(F.collect_set(F.struct("at", F.lit(0).alias("skip"))).alias("places")), "places")
    held = cut(texts.join(places, "key").select("id", "key", "text", "places"), "held")
    shape = f"g long, id {kind}, key long, at int, skip int, lo int, left binary, right binary, goes_on boolean, bound boolean"
    spans, width, now = [], FIRST, held
    while True:
        settle(docs.sparkSession)
        rows = cut(now.mapInArrow(trimmed(_suffix_rows(anchor, spread, width)), shape), "suffixes")
        parts = _partitions(rows, min_words, group, kind)
        both = parts[0]
        for more in parts[1:]:
            both = both.unionByName(more)
        both = cut(both, "repeats")
        spans.append(both.filter("more is null").select("id", "key", "first_word", "end_word", "copies", "original"))
        onward = both.filter("more is not null")
        if onward.isEmpty():
            break
        onward = onward.groupBy("key").agg(F.collect_set(F.struct("at", F.col("more").alias("skip"))).alias("places"))
        now, width = held.drop("places").join(onward, "key").select("id", "key", "text", "places"), width * GROWTH
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    every = every.groupBy("id", "key", "first_word", "end_word").agg(F.max("copies").alias("copies"), F.min("original").alias("original"))
    own = W.partitionBy("key", "id").orderBy("first_word", F.desc("end_word"))
    reach = F.max("end_word").over(own.rowsBetween(W.unboundedPreceding, -1))
    longest = every.withColumn("reach", reach).filter("reach is null or end_word > reach").drop("reach")
    return _counted_in_runs(longest, held, min_words, kind).select(F.col("id").alias("doc_id"), "first_word", "end_word", "copies", F.col("original").alias("original_doc_id"))
