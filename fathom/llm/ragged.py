"""Vectorised text kernels: many documents as one byte array with offsets.

Everything works on the UTF-8 bytes that Arrow delivers, about a megabyte at a time, so a
kernel's memory depends on its chunk (or its longest document) and never on the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Cache(dict):
    """Travels to a worker empty."""

    def __reduce__(self):
        return _Cache, ()


_powers = _Cache()

#: True for bytes that belong to a word: ASCII letters and digits, and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: True for every byte but ASCII white space.
NONSPACE = np.ones(256, bool)
NONSPACE[[9, 10, 11, 12, 13, 32]] = False


def byte_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of about limit bytes; null is empty text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and words per document; a word never crosses documents."""
    n, size = len(offsets) - 1, len(data)
    if size == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
    word = kind[data]
    before = np.empty(size, bool)
    before[0] = False
    before[1:] = word[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < size)]
    before[edges] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(size, bool)
    after[-1] = False
    after[:-1] = word[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1; those of an ordinary chunk are kept, a longer text's only while it is worked on."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= CHUNK_BYTES + 1:
            _powers[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, from prefix sums of a polynomial modulo 2**64."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, "up", len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_INVERSE, "down", len(data) + 1)[starts])


def chain(hashes: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Hash of the length consecutive words from each index in first."""
    h = np.full(len(first), 0x51ED270B, np.uint64)
    for k in range(length):
        h = h * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[first + k]
    return mix(h)


def first_of_document(counts: np.ndarray) -> np.ndarray:
    """Index of each document's first word."""
    return np.cumsum(counts) - counts


def ngram_starts(counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index and document of each n-gram that lies inside one document."""
    doc = np.repeat(np.arange(len(counts)), counts)
    end = np.repeat(np.cumsum(counts), counts)
    at = np.arange(len(doc))
    keep = at + n <= end
    return at[keep], doc[keep]
