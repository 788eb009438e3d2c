"""Knowledge sources and sinks: Markdown folders, zip packs, evaluation cases, pack export.

A knowledge table has path, title, body, source_sha256, language, tags, priority and metadata.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from fathom.functions.batches import by_row
from fathom.functions.chunking import strip
from fathom.functions.text import SPACE, title_case

MANIFEST = "pack.json"
CASE = "query string, expected_tag string, difficulty string, expected_language string"
#: Where a line ends, as Python sees it.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_LIST = ArrayType(StringType())
FRONT = StructType([StructField("meta", MapType(StringType(), _LIST)), StructField("listed", _LIST)])


def front_matter(text: str) -> dict:
    """meta: key -> values (one for a scalar), listed: keys written as lists, body: the rest, stripped."""
    lines = text.splitlines()
    if not lines or lines[0].strip() != "---":
        return {"meta": {}, "listed": [], "body": text.strip()}
    end = next((k for k, line in enumerate(lines[1:], 1) if line.strip() == "---"), None)
    if end is None:
        return {"meta": {}, "listed": [], "body": text.strip()}
    meta: dict[str, list[str]] = {}
    listed: set[str] = set()
    key = None
    for line in map(str.strip, lines[1:end]):
        if not line or line[0] == "#":
            continue
        if key is not None and line.startswith("- "):
            meta[key].append(line[2:].strip())
            continue
        name, colon, value = map(str.strip, line.partition(":"))
        if not colon:
            key = None
            continue
        meta[name] = [value] if value else []
        (listed.discard if value else listed.add)(name)
        key = None if value else name
    return {"meta": meta, "listed": sorted(listed), "body": "\n".join(lines[end + 1 :]).strip()}


#: A text's first lines, from a line of three dashes to the next.
_BLANK = rf"[{SPACE}&&[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]]*+"
HEAD = rf"(?s)^{_BLANK}---{_BLANK}(?:{LINE_END}).*?(?<=[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]){_BLANK}---{_BLANK}(?:{LINE_END}|\z)"


@F.arrow_udf(FRONT)
def _split(head: pa.Array) -> pa.Array:
    kind = pa.struct([("meta", pa.map_(pa.string(), pa.list_(pa.string()))), ("listed", pa.list_(pa.string()))])

    def of(text: str | None) -> dict:
        found = front_matter(text or "")
        return {"meta": list(found["meta"].items()), "listed": found["listed"]}

    return by_row(of, kind, head)


def documents_of(texts: DataFrame) -> DataFrame:
    """The knowledge table of (path, text). Only front matter goes through Python, where a batch of whole texts would be held several times over."""
    head = F.regexp_extract(F.coalesce("text", F.lit("")), HEAD, 0)
    rest = F.regexp_replace(F.substr("text", F.length("head") + 1), LINE_END, "\n")
    body = strip(F.when(F.col("head") != "", rest).otherwise(F.coalesce("text", F.lit(""))))
    rows = texts.withColumn("head", head).withColumn("f", _split("head")).withColumn("body", body)
    scalar = lambda k: F.when(~F.array_contains("f.listed", F.lit(k)), F.get(F.try_element_at("f.meta", F.lit(k)), F.lit(0)))
    lines = F.transform(F.split("body", LINE_END), strip)
    heading = F.get(F.filter(lines, lambda line: line.startswith("#")), F.lit(0))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/:]+)$", 1), r"(?<=.)\.[^.]*$", "")
    title = F.coalesce(scalar("title"), strip(F.regexp_replace(heading, "^#+", "")), title_case(F.regexp_replace(stem, "[_-]", " ")))
    return rows.select(
        "path", title.alias("title"), "body", F.sha2(F.encode("text", "utf-8"), 256).alias("source_sha256"), F.coalesce(scalar("language"), F.lit("unknown")).alias("language"),
        F.coalesce(F.try_element_at("f.meta", F.lit("tags")), F.array().cast("array<string>")).alias("tags"), F.coalesce(scalar("priority"), F.lit("normal")).alias("priority"), F.col("f.meta").alias("metadata"),
    )


def _relative(path: Column, root: str) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), f"^{re.escape(root.rstrip('/'))}/", "")


def read_folder(spark: SparkSession, root: str) -> DataFrame:
    """All .md files below root, in any depth.

    Spark's listing leaves out names that start with a dot or underscore; in a folder that the driver can see
    these are found by name and read where the rest is.
    """
    empty = spark.createDataFrame([], "path string, text string")
    here = Path(root.removeprefix("file://"))
    if not here.exists() and "://" not in root:
        return documents_of(empty)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    text = F.regexp_replace(F.decode("content", "utf-8"), "\r\n?", "\n")
    texts = files.select(_relative(F.col("path"), root.removeprefix("file://")).alias("path"), text.alias("text"))
    hidden = [(str(p.relative_to(here)), str(p)) for p in sorted(here.rglob("*.md")) if p.is_file() and any(part[0] in "._" for part in p.relative_to(here).parts)] if here.is_dir() else []
    if hidden:
        texts = texts.unionByName(spark.createDataFrame(hidden, "path string, file string").mapInArrow(_opened, "path string, text string"))
    return documents_of(texts)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([Path(f).read_text("utf-8") for f in batch.column(1).to_pylist()], pa.string())], ["path", "text"])


def is_pack_entry(name: str) -> bool:
    """A Markdown entry outside hidden and resource folders."""
    parts = name.replace("\\", "/").split("/")
    return bool(parts[-1]) and parts[-1].casefold().endswith(".md") and not any(p.startswith(".") or p == "__MACOSX" for p in parts)


def read_packs(spark: SparkSession, root: str) -> DataFrame:
    """The knowledge table of a .zip file, or of all below a folder; an entry's path is pack.zip:entry."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as pack:
                    names = sorted(filter(is_pack_entry, pack.namelist()))
                    texts = [pack.read(n).decode("utf-8") for n in names]
                yield pa.RecordBatch.from_pydict({"path": [f"{path.rsplit('/', 1)[-1]}:{n}" for n in names], "text": texts}, pa.schema([("path", pa.string()), ("text", pa.string())]))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[zZ][iI][pP]").load(root)
    return documents_of(files.select("path", "content").mapInArrow(entries, "path string, text string"))


def read_knowledge(spark: SparkSession, source: str) -> DataFrame:
    return read_packs(spark, source) if source.casefold().endswith(".zip") and Path(source).is_file() else read_folder(spark, source)


def read_manifest(source: str, name: str = MANIFEST) -> dict:
    """The manifest at the root of a folder or zip pack; {} without one."""
    path = Path(source)
    if path.is_dir():
        own = path / name
        return json.loads(own.read_text("utf-8")) if own.is_file() else {}
    if path.is_file() and path.suffix.casefold() == ".zip":
        with zipfile.ZipFile(path) as pack:
            return json.loads(pack.read(name)) if name in pack.namelist() else {}
    return {}


def describe_pack(kb: DataFrame, source: str, name: str = MANIFEST) -> dict:
    """The manifest's fields with defaults; without one the languages that the documents declare."""
    manifest = read_manifest(source, name)
    languages = manifest.get("languages") or []
    if not manifest:
        languages = kb.filter("language <> 'unknown'").agg(F.array_sort(F.collect_set("language"))).first()[0]
    blank = {"name": Path(source).stem, "version": "unknown", "description": "", "license": "unknown", "source": "local"}
    return {k: str(manifest.get(k) or v) for k, v in blank.items()} | {"languages": [languages] if isinstance(languages, str) else [str(x) for x in languages] if isinstance(languages, list) else [], "path": source, "metadata": manifest}


def export_pack(source: str, output: str, name: str = MANIFEST) -> str:
    """Write a folder's Markdown and manifests as a zip that is the same, byte for byte, each time."""
    root = Path(source)
    if not root.exists():
        raise ValueError(f"no such knowledge folder: {source}")
    if not root.is_dir():
        raise ValueError("only a folder can be exported")
    files = {p.relative_to(root).as_posix(): p for p in root.rglob("*") if p.is_file() and (p.name == name or p.suffix.casefold() == ".md")}
    if not files:
        raise ValueError("nothing to export")
    Path(output).parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(output, "w") as pack:
        for entry in sorted(files):
            info = zipfile.ZipInfo(entry, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED
            pack.writestr(info, files[entry].read_bytes())
    return output


def write_files(texts: DataFrame, root: str) -> None:
    """(path, text) as files below a folder that driver and executors share."""
    base = root.removeprefix("file://")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = Path(base, path)
                target.parent.mkdir(parents=True, exist_ok=True)
                target.write_text(said or "", "utf-8")
            yield batch.slice(0, 0).select([0])

    texts.select("path", "text").mapInArrow(write, "path string").count()


def write_packs(texts: DataFrame, root: str, entries: int = 10_000) -> None:
    """(path, text) as zip packs of up to so many entries, the same bytes each time, below a folder that driver and executors share."""
    base = root.removeprefix("file://")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            Path(base).mkdir(parents=True, exist_ok=True)
            for first in range(0, len(batch), entries):
                rows = sorted(zip(*(c.slice(first, entries).to_pylist() for c in batch.columns)))
                target = Path(base, f"{hashlib.sha256(rows[0][0].encode()).hexdigest()[:16]}.zip")
                with zipfile.ZipFile(target, "w") as pack:
                    for path, said in rows:
                        info = zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0))
                        info.compress_type = zipfile.ZIP_DEFLATED
                        pack.writestr(info, said or "")
            yield batch.slice(0, 0).select([0])

    texts.select("path", "text").mapInArrow(write, "path string").count()


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from JSON lines; a missing file has none."""
    if not Path(path).exists() and "://" not in path:
        return spark.createDataFrame([], CASE)
    return spark.read.schema(CASE).json(path).filter("query is not null").fillna({"difficulty": "standard"})


def write_json(row: dict, path: str) -> None:
    """Sorted keys, ASCII, indented, with a line end; for reports and single-document indexes."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(row, ensure_ascii=True, indent=2, sort_keys=True) + "\n", "utf-8")


def file_digest(path: str) -> str:
    """SHA-256 of a file, read a megabyte at a time."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            digest.update(part)
    return digest.hexdigest()
