"""Command line: python -m fathom.cli --source FOLDER_OR_ZIP [QUERY...]"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fathom import web
from fathom.operators import packs
from fathom.operators.answer import NOTICE, REFUSAL
from fathom.plans import reports
from fathom.plans.engine import STRATEGIES, Engine
from fathom.sources import markdown, pdf
from fathom.streaming.session import CLEAR, Session


def positive(text: str) -> int:
    if (n := int(text)) < 1:
        raise argparse.ArgumentTypeError("must be 1 or more")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fathom")
    p.add_argument("query", nargs="*", help="one query; without one, a console")
    p.add_argument("--source", default="knowledge", help="knowledge folder or zip pack")
    p.add_argument("--manifest", default=markdown.MANIFEST)
    p.add_argument("--strategy", choices=tuple(STRATEGIES), default="lexical")
    p.add_argument("--language")
    p.add_argument("--top-k", type=positive, default=3)
    p.add_argument("--format", choices=("text", "json", "sources"), default="text")
    for flag, what in (
        ("--synthesize", "answer by the n-gram model of the best passage"), ("--stream", "print line by line"), ("--list", "list the documents"), ("--validate", "check the pack"), ("--pack-info", "describe the pack"),
        ("--self-check", "check this installation"), ("--serve", "serve a page"), ("--require-valid", "export only a sound pack"),
    ):
        p.add_argument(flag, action="store_true", help=what)
    for flag, what in (
        ("--eval", "evaluate the cases of a JSON lines file"), ("--eval-output", "where to write the evaluation"), ("--build-index", "write the audit index"), ("--build-model", "write the n-gram model"), ("--model-info", "describe a model file"),
        ("--export", "write a zip pack"), ("--import-pdf", "turn a PDF into Markdown"), ("--import-output", "where to write it"),
    ):
        p.add_argument(flag, metavar="PATH", help=what)
    p.add_argument("--import-title")
    p.add_argument("--import-tags", default="imported,pdf")
    p.add_argument("--import-priority", default="normal")
    p.add_argument("--import-points", type=int, default=8)
    p.add_argument("--model-order", type=positive, default=2)
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8765)
    return p


def _rows(engine: Engine, query: str, a: argparse.Namespace):
    asked = engine.kb.sparkSession.createDataFrame([(0, query)], "qid long, query string")
    return asked, engine.search(asked, a.top_k).orderBy("rank").select("rank", "title", F.col("path").alias("source"), "language", "tags", "priority", "score", "confidence", "passage", "matched_terms").collect()


def answer(engine: Engine, query: str, a: argparse.Namespace) -> str:
    """One query's output; at most top_k rows reach the driver."""
    if a.format == "text":
        asked = engine.kb.sparkSession.createDataFrame([(0, query)], "qid long, query string")
        said = (engine.synthesize(asked, a.top_k) if a.synthesize else engine.answer(asked, a.top_k)).first()["answer"]
        return f"{NOTICE}\n\n{said}"
    asked, rows = _rows(engine, query, a)
    if a.format == "sources":
        lines = [f"{r['rank']}. [{r['confidence']}] {r['title']} | {r['source']} | score={r['score']:.3f} | tags={', '.join(r['tags']) or 'none'}" for r in rows]
        return "\n".join([f"Sources for: {query}", *lines]) if rows else REFUSAL
    accepted = any(r["confidence"] in ("HIGH", "MEDIUM") for r in rows)
    said = (engine.synthesize(asked, a.top_k) if a.synthesize else engine.answer(asked, a.top_k, triage=False)).first()["answer"]
    found = {"query": query, "accepted": accepted, "answer": said, "results": [{k: v for k, v in r.asDict(True).items() if k != "rank"} for r in rows]}
    return json.dumps(found if accepted else found | {"message": REFUSAL}, indent=2, sort_keys=True)


def console(engine: Engine, a: argparse.Namespace, read=input) -> int:
    engine.stored()
    session = Session(engine, a.top_k)
    print(NOTICE)
    print("Ask, or type 'clear' to forget, 'exit' to leave.")
    while True:
        try:
            said = read("> ").strip()
        except (EOFError, KeyboardInterrupt):
            print()
            return 0
        if said.casefold() in ("exit", "quit", ":q"):
            return 0
        if said.casefold() in CLEAR:
            session.clear()
            print("Context cleared.")
        elif said:
            print(session.answer(said))


def check_pack(kb, a: argparse.Namespace) -> int:
    issues = packs.validate_pack(kb, markdown.read_manifest(a.source, a.manifest)).collect()
    failed = any(r["severity"] == "error" for r in issues)
    print("\n".join([f"Pack validation: {'FAIL' if failed else 'PASS'}", *(f"{r['severity'].upper()}: {r['message']}" for r in issues)]))
    return int(failed)


def export(kb, a: argparse.Namespace) -> int:
    if a.require_valid and check_pack(kb, a):
        return 1
    try:
        path = markdown.export_pack(a.source, a.export, a.manifest)
    except ValueError as e:
        print(f"Export failed: {e}")
        return 1
    print(f"Wrote knowledge pack: {path}\nSHA-256: {markdown.file_digest(path)}")
    return 0


def import_pdf(spark: SparkSession, a: argparse.Namespace) -> int:
    try:
        pages = pdf.read_pdf(spark, a.import_pdf)
        tags = tuple(t.strip() for t in a.import_tags.split(",") if t.strip())
        found = pdf.document_to_markdown(pages, a.import_title, a.language or "unknown", tags, a.import_priority, a.import_points).first()
        if found is None:
            raise RuntimeError("no text was found; the PDF may hold images only")
    except Exception as e:  # noqa: BLE001 - whatever a PDF library raises is the user's message
        print(f"PDF import failed: {e}")
        return 1
    out = Path(a.import_output or Path(a.import_pdf).with_suffix(".md"))
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(found["markdown"], encoding="utf-8")
    print(f"Wrote Markdown: {out}")
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.model_info:
        print(reports.describe_model(a.model_info))
        return 0
    spark = SparkSession.builder.appName("fathom").getOrCreate()
    if a.import_pdf:
        return import_pdf(spark, a)
    kb = markdown.read_knowledge(spark, a.source)
    engine = Engine(kb, a.strategy, a.language)
    if a.self_check:
        checks = reports.self_check(kb)
        print(reports.show_checks(checks))
        return int(not all(ok for _, ok, _ in checks))
    if a.pack_info:
        pack = markdown.describe_pack(kb, a.source, a.manifest)
        shown = {"Name": pack["name"], "Version": pack["version"], "Languages": ", ".join(pack["languages"]) or "unknown", "Documents": kb.count(), "License": pack["license"], "Source": pack["source"], "Description": pack["description"], "Path": pack["path"]}
        print("\n".join(f"{k}: {v}" for k, v in shown.items() if v != ""))
    elif a.list:
        rows = [f"{r['language']} | {r['priority']} | {r['title']} | {', '.join(r['tags']) or 'none'} | {r['path']}" for r in packs.list_knowledge(kb, a.language).toLocalIterator()]
        print("\n".join(rows) or "No knowledge documents found.")
    elif a.validate:
        return check_pack(kb, a)
    elif a.export:
        return export(kb, a)
    elif a.build_model:
        print(f"Wrote local n-gram model: {reports.write_model(kb, a.build_model, a.model_order)}")
    elif a.build_index:
        print(f"Wrote offline index: {reports.write_index(kb, a.build_index, markdown.describe_pack(kb, a.source, a.manifest))}")
    elif a.serve:
        web.serve(engine, a.host, a.port)
    elif a.eval:
        report = reports.evaluation_report(engine, markdown.read_cases(spark, a.eval), a.top_k)
        print(reports.show_evaluation(report))
        print(f"Wrote evaluation report: {reports.write_report(report, a.eval_output or 'eval/results.json')}")
    elif a.query:
        said = answer(engine, " ".join(a.query), a)
        for line in said.splitlines() if a.stream else [said]:
            print(line, flush=a.stream)
    else:
        return console(engine, a)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
