"""Chunks, sentences and windows.

sentences() and hard_wrap() are column expressions. Greedy packing and two-sided window growth are
recurrences over a text's units, so they run as Arrow functions, windows only over the top results.
"""

from __future__ import annotations

import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from fathom.functions.batches import by_row
from fathom.functions.text import ALIASES, SPACE, STOPWORDS, WHITE, fold_text

LIMIT = 700
_END = re.compile(r"(?<=[.!?])\s+")
_BULLET = re.compile(r"\s*(?:\d+[.)]|[-*])\s+")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def sentences(text: Column) -> Column:
    """Sentences of one paragraph, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, f"(?<=[.!?])[{SPACE}]+", -1), strip), lambda s: s != "")


def hard_wrap(text: Column, limit: int = LIMIT) -> Column:
    """Pieces of at most limit characters, cut at the last blank before the limit where there is one."""
    piece = rf"(?s)\G\s*(.{{1,{limit}}}\s*$|.{{1,{limit - 1}}}(?= )|.{{{limit}}})"
    return F.transform(F.regexp_extract_all(text, F.lit(piece), F.lit(1)), strip)


def chunked(text: Column, limit: int = LIMIT) -> Column:
    """chunks() of each text."""

    @F.arrow_udf(ArrayType(StringType()))
    def of(text: pa.Array) -> pa.Array:
        return by_row(lambda t: None if t is None else chunks(t, limit), pa.list_(pa.string()), text)

    return of(text)


def wrap(text: str, limit: int) -> list[str]:
    found = []
    while len(text) > limit:
        at = text.rfind(" ", 1, limit)
        at = limit if at < 0 else at
        found.append(text[:at].strip())
        text = text[at:].strip()
    return found + [text] * bool(text)


def _paragraphs(text: str) -> list[str]:
    return [p for p in map(str.strip, text.split("\n\n")) if p]


def split_sentences(paragraph: str) -> list[str]:
    return [s for s in map(str.strip, _END.split(paragraph)) if s]


def chunks(text: str, limit: int = LIMIT) -> list[str]:
    """Paragraphs, the long ones packed from their sentences."""
    found: list[str] = []
    for paragraph in _paragraphs(text):
        if len(paragraph) <= limit:
            found.append(paragraph)
            continue
        open_chunk = False
        for s in split_sentences(paragraph):
            if len(s) > limit:
                found += wrap(s, limit)
                open_chunk = False
            elif open_chunk and len(found[-1]) + 1 + len(s) <= limit:
                found[-1] += " " + s
            else:
                found.append(s)
                open_chunk = True
    return found or [text[:limit].strip()]


def units(paragraph: str) -> list[str]:
    """List items where the paragraph has bullets, else sentences."""
    lines = [line for line in map(str.strip, paragraph.splitlines()) if line]
    if len(lines) > 1 and any(map(_BULLET.match, lines)):
        return [_BULLET.sub("", line, count=1).strip() if _BULLET.match(line) else line for line in lines]
    return split_sentences(paragraph)


def _grown(edge: list[int], centre: int, limit: int) -> tuple[int, int]:
    """The units around centre, right before left in each turn, that fit; edge holds prefix lengths with a blank each."""
    low, high, last = centre, centre + 1, len(edge) - 1
    while True:
        before = low, high
        if high < last and edge[high + 1] - edge[low] - 1 <= limit:
            high += 1
        if low > 0 and edge[high] - edge[low - 1] - 1 <= limit:
            low -= 1
        if (low, high) == before:
            return before


def windows(text: str, limit: int = LIMIT) -> list[str]:
    """A window around every sentence or list item, each once; chunks where there is none."""
    found: dict[str, None] = {}
    for paragraph in _paragraphs(text):
        parts = units(paragraph)
        edge = [0, *accumulate(len(p) + 1 for p in parts)]
        for low, high in dict.fromkeys(_grown(edge, k, limit) for k in range(len(parts))):
            window = " ".join(parts[low:high]).strip()
            if len(window) > limit:
                window = wrap(window, limit)[0]
            if window:
                found.setdefault(window)
    return list(found) or chunks(text, limit)


def tokenise(text: str) -> list[str]:
    return [t for t in re.findall("[a-z0-9]+", fold_text(text)) if len(t) > 1 and t not in STOPWORDS]


def expand_tokens(found: list[str]) -> list[str]:
    out: dict[str, None] = {}
    for t in found:
        out.setdefault(t)
        if len(t) > 4 and t.endswith("es"):
            out.setdefault(t[:-2])
        elif len(t) > 3 and t.endswith("s"):
            out.setdefault(t[:-1])
        for goal in ALIASES.get(t, ()):
            out.setdefault(goal)
    return list(out)


def best_passage(body: str, query: str, limit: int = LIMIT) -> str:
    """The window that matches the query best; the shorter, then the earlier one on ties."""
    every, wanted, phrase = windows(body, limit), set(expand_tokens(tokenise(query))), query.casefold()
    if not wanted:
        return every[0]

    def worth(window: str) -> tuple[float, int]:
        have = tokenise(window)
        if not have:
            return 0.0, 0
        own = set(have)
        same = len(own & wanted)
        return 4.0 * same + sum(t in wanted for t in have) + same / len(own) + (phrase in window.casefold()), -len(window)

    return max(every, key=worth)


@F.arrow_udf(StringType())
def passage(body: pa.Array, query: pa.Array) -> pa.Array:
    """best_passage of each row; null where a side is null."""
    return pa.array([None if b is None or q is None else best_passage(b, q) for b, q in zip(body.to_pylist(), query.to_pylist())], pa.string())


@F.arrow_udf(ArrayType(StringType()))
def text_windows(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else windows(t) for t in text.to_pylist()], pa.list_(pa.string()))
