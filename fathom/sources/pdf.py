"""PDF pages (path, source_sha256, page, text) and what is made of them: points, Markdown, titles."""

from __future__ import annotations

import hashlib
import importlib
import io
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fathom.functions.batches import by_row
from fathom.functions.chunking import split_sentences, strip
from fathom.functions.text import casefold, title_case

VERBS = "do not|never|avoid|stop|discard|move|evacuate|seek|call|check|keep|cover|store|separate|mark|rinse|wash|drink|use|should|warning"
PAGE = "path string, source_sha256 string, page int, text string"


def _reader():
    for name in ("pypdf", "PyPDF2"):
        try:
            return importlib.import_module(name).PdfReader
        except ImportError:
            continue
    return None


def _pages(content: bytes) -> list[str]:
    """The pages' texts by the first library that is here and finds any."""
    reader = _reader()
    found = [p.extract_text() or "" for p in reader(io.BytesIO(content)).pages] if reader else []
    if any(t.strip() for t in found):
        return found
    try:
        fitz = importlib.import_module("fitz")
    except ImportError as missing:
        if reader is None:
            raise RuntimeError("reading PDF files needs pypdf, PyPDF2 or PyMuPDF") from missing
        return found
    with fitz.open(stream=content, filetype="pdf") as opened:
        return [p.get_text("text") or "" for p in opened]


def read_pdf(spark: SparkSession, root: str) -> DataFrame:
    """The pages of the PDF files at root that have text, numbered from 1."""

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("source_sha256", pa.string()), ("page", pa.int32()), ("text", pa.string())])
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sha = hashlib.sha256(content).hexdigest()
                yield pa.RecordBatch.from_pylist([{"path": path, "source_sha256": sha, "page": k, "text": t} for k, t in enumerate(map(clean_text, _pages(content)), 1) if t], schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(root)
    return files.select("path", "content").mapInArrow(pages, PAGE)


_VERB = re.compile(rf"(?<!\w)(?ai:{VERBS})(?!\w)")
_HEADING = re.compile("[A-Z][A-Za-z0-9 ,:/()'-]{3,80}")


def clean_text(text: str) -> str:
    """Line ends as line feeds, runs of blanks and tabs as one blank, lines trimmed, empty ones dropped."""
    return "\n".join(filter(None, map(str.strip, re.sub("[ \t]+", " ", re.sub("\r\n?", "\n", text)).split("\n"))))


def markdown_lines(text: str) -> str:
    """The text's lines, trimmed, those that look like one as headings."""
    return "\n".join("### " + line if _HEADING.fullmatch(line) else line for line in map(str.strip, text.split("\n")) if line)


def sentence_score(sentence: str) -> int:
    """3 for a verb that says what to do, 2 each for alarm and prohibition, 1 for a handy length."""
    low = sentence.lower()
    alarm, ban = any(w in low for w in ("warning", "danger", "urgent")), any(w in low for w in ("do not", "never", "avoid"))
    return 3 * bool(_VERB.search(sentence)) + 2 * alarm + 2 * ban + (40 <= len(sentence) <= 240)


def best_sentences(text: str, limit: int = 8) -> list[tuple[int, int, int, str]]:
    """(-score, line, place, sentence) of the best sentences of 25 characters or more, each once (case aside), the earlier first on ties."""
    best: dict[str, tuple[int, int, int, str]] = {}
    for line, said in enumerate(text.split("\n")):
        for at, s in enumerate(split_sentences(said)):
            if len(s) >= 25 and (score := sentence_score(s)):
                key, found = s.lower().replace("ß", "ss"), (-score, line, at, s)
                best[key] = min(best.get(key, found), found)
    return sorted(best.values())[: max(limit, 1)]


def important_points(texts: DataFrame, limit: int = 8) -> DataFrame:
    """(path, rank, sentence, score): of each text (path, text) its best sentences of 25 characters or more, each once (case aside), the earlier first on ties.

    A text's best are found where it lies; only they are shuffled, for paths that have several texts.
    """

    @F.arrow_udf("array<struct<low: int, line: int, at: int, sentence: string>>")
    def found(text: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("low", pa.int32()), ("line", pa.int32()), ("at", pa.int32()), ("sentence", pa.string())]))
        return by_row(lambda t: None if t is None else [dict(zip(("low", "line", "at", "sentence"), b)) for b in best_sentences(t, limit)], kind, text)

    good = texts.select("path", F.explode(found("text")).alias("b"))
    first = good.groupBy("path", casefold(F.col("b.sentence")).alias("key")).agg(F.min("b").alias("b"))
    order = W.partitionBy("path").orderBy("b.low", "b.line", "b.at")
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(limit, 1)).select("path", "rank", "b.sentence", (-F.col("b.low")).alias("score"))


def first_title(text: Column) -> Column:
    """The first line of 4 to 100 characters."""
    return F.get(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: F.length(x).between(4, 100)), F.lit(0))


def _gathered(pages: DataFrame) -> DataFrame:
    """(path, sha, n, pages in order) of each PDF: the one shuffle of its text."""
    return pages.groupBy("path").agg(F.max("source_sha256").alias("sha"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages"))


def _made(points: int) -> Column:
    """(title, markdown, points) of a PDF's pages."""

    def of(pages: list[dict]) -> dict:
        whole = "\n\n".join(p["text"] for p in pages)
        title = next((line for line in map(str.strip, whole.split("\n")) if 4 <= len(line) <= 100), None)
        return {
            "title": title, "markdown": "\n\n".join(f"### Page {p['page']}\n\n{markdown_lines(p['text'])}" for p in pages),
            "points": "\n".join("- " + b[3] for b in best_sentences(whole, points)) if points else "",
        }

    @F.arrow_udf("struct<title: string, markdown: string, points: string>")
    def made(pages: pa.Array) -> pa.Array:
        return by_row(of, pa.struct([("title", pa.string()), ("markdown", pa.string()), ("points", pa.string())]), pages)

    return made("pages").alias("made")


def _title() -> Column:
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]+?)(?:\\.[^./]*)?$", 1), "[_-]", " ")
    return F.coalesce("made.title", title_case(stem))


def to_markdown(pages: DataFrame) -> DataFrame:
    """(path, title, markdown) of each PDF."""
    return _gathered(pages).select("path", _made(0)).select("path", _title().alias("title"), "made.markdown")


def document_to_markdown(pages: DataFrame, title: str | None = None, language: str = "unknown", tags: tuple[str, ...] = (), priority: str = "normal", points: int = 8) -> DataFrame:
    """(path, markdown): each PDF as a knowledge document with front matter, its important points and its text."""
    rows = _gathered(pages).select("path", "sha", "n", _made(max(points, 1)))
    head = [
        F.lit("---\ntitle: "), F.lit(title) if title else _title(), F.lit(f"\nlanguage: {language}\ntags:\n" + "\n".join(f"  - {t}" for t in tags or ("imported",)) + f"\npriority: {priority}\nsource_type: pdf\nsource_file: "),
        F.regexp_extract("path", "([^/]*)$", 1), F.lit("\nsource_sha256: "), "sha", F.lit("\npages: "), F.col("n").cast("string"),
    ]
    best = F.when(F.col("made.points") != "", F.col("made.points")).otherwise("- No high-signal summary points were detected.")
    return rows.select("path", F.concat(*head, F.lit("\n---\n\n## Important Points\n\n"), best, F.lit("\n\n## Extracted Text\n\n"), "made.markdown", F.lit("\n")).alias("markdown"))


def paged(lines: int) -> Callable[[str], Column]:
    """Of a text that stands for a PDF file its pages, cleaned, of so many lines before; empty ones are left out."""

    def of(text: str | None) -> list[dict]:
        rows = (text or "").split("\n")
        cleaned = enumerate((clean_text("\n".join(rows[k : k + lines])) for k in range(0, len(rows), lines)), 1)
        return [{"page": k, "text": t} for k, t in cleaned if t]

    @F.arrow_udf("array<struct<page: int, text: string>>")
    def pages(text: pa.Array) -> pa.Array:
        return by_row(of, pa.list_(pa.struct([("page", pa.int32()), ("text", pa.string())])), text)

    return pages
