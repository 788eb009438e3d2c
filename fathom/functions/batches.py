"""Tokens of Arrow batches of texts by array operations, without a Python object a token.

The same tokens as text.tokens(): it folds with Catalyst's expressions, which take several times as long
over a corpus and can't count in place. There are no Spark functions here: functions for tasks are pickled with
what they name of this module, and a Spark function that was called can't be pickled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fathom.functions.text import STOPWORDS, fold_text

#: Bytes of text that are worked on at a time, so that a worker's memory doesn't follow the batch.
SLICE_BYTES = 8 << 20
_FOREIGN = re.compile(rb"[\x80-\xff]+")
_LETTERS = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_STOP = pa.array(sorted(STOPWORDS), pa.string())
_folded: dict[bytes, bytes] = {}


def _fold(found: re.Match) -> bytes:
    run = found[0]
    if run not in _folded:
        if len(_folded) > 100_000:
            _folded.clear()
        _folded[run] = fold_text(run.decode("utf-8", "replace")).encode("ascii", "replace")
    return _folded[run]


def slices(batch: pa.RecordBatch, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """batch in pieces of about most bytes, a row at least."""
    most = most or SLICE_BYTES
    size = np.zeros(len(batch), np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // most
    first = 0
    for last in [*(np.flatnonzero(np.diff(part)) + 1), len(batch)]:
        if last > first:
            yield batch.slice(first, last - first)
        first = last


def flat_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all texts in order, and where each text's begin (one more at the end). Null has none."""
    rows = [b if b.isascii() else _FOREIGN.sub(_fold, b) for b in pc.fill_null(texts, "").cast(pa.binary()).to_pylist()]
    if not rows:
        return pa.array([], pa.string()), np.zeros(1, np.int64)
    ends = np.cumsum([len(b) + 1 for b in rows])
    said = np.frombuffer((b" ".join(rows) + b" ").translate(_LETTERS), np.uint8)
    held = said != 32
    edges = np.flatnonzero(np.diff(held, prepend=False))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    long = sizes > 1
    held[starts[~long]] = False
    starts, sizes = starts[long], sizes[long]
    at = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=at[1:])
    words = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(at), pa.py_buffer(said[held]))
    telling = pc.invert(pc.is_in(words, _STOP))
    kept = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(telling.to_numpy(zero_copy_only=False), out=kept[1:])
    return words.filter(telling), kept[np.concatenate([[0], np.searchsorted(starts, ends)])]


def owners(begins: np.ndarray) -> np.ndarray:
    """The row of each item of lists that begin there."""
    return np.repeat(np.arange(len(begins) - 1), np.diff(begins))


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, and the distinct words in order, to which the numbers point."""
    found = words.dictionary_encode()
    order = pc.array_sort_indices(found.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[found.indices.to_numpy()], found.dictionary.take(pa.array(order))


def listed(begins: np.ndarray, items: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), items)


def joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def by_row(of: Callable, kind: pa.DataType, *columns: pa.Array, rows: int = 500) -> pa.Array:
    """of() each row, so many of which are Python objects at a time."""
    return joined([pa.array([of(*r) for r in zip(*(c.slice(k, rows).to_pylist() for c in columns))], kind) for k in range(0, len(columns[0]), rows)], kind)
