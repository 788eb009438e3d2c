"""Files and texts for people: the audit index, the n-gram model, the evaluation report, the self-check.

Files are JSON with sorted keys, ASCII, indented. Index and model are written as their rows arrive, one at a
time, so the driver holds a document or a prefix, never the table; their scalable forms are
postings.audit_index and ngram.transitions.
"""

from __future__ import annotations

import json
import platform
import sys
import textwrap
import time
from collections.abc import Iterator
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators import evaluate, ngram, postings
from fathom.plans.engine import Engine
from fathom.plans.shared import materialise
from fathom.sources.markdown import write_json

INDEX_VERSION = MODEL_VERSION = 1


def _json(value: object) -> str:
    return json.dumps(value, ensure_ascii=True, indent=2, sort_keys=True)


def _write_around(path: str, before: dict, name: str, items: Iterator[str], ends: str, after: dict) -> str:
    """An object whose member name, between those of before and after, is written item by item."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    member = lambda k, v: f"  {json.dumps(k)}: {textwrap.indent(_json(v), '  ').lstrip()}"
    with target.open("w", encoding="utf-8") as f:
        f.write("{\n" + "".join(member(k, v) + ",\n" for k, v in sorted(before.items())) + f"  {json.dumps(name)}: {ends[0]}")
        some = False
        for item in items:
            f.write((",\n" if some else "\n") + textwrap.indent(item, "    "))
            some = True
        f.write(("\n  " if some else "") + ends[1] + "".join(",\n" + member(k, v) for k, v in sorted(after.items())) + "\n}\n")
    return path


def write_index(kb: DataFrame, path: str, pack: dict | None = None) -> str:
    """Counts, the pack and each document with its terms."""
    entries = materialise(postings.audit_index(kb), "index")
    terms = entries.select(F.explode(F.map_keys("terms")).alias("t")).agg(F.countDistinct("t")).first()[0]
    rows = entries.orderBy(F.split("path", "/")).toLocalIterator()
    after = {"index_version": INDEX_VERSION, "term_count": terms} | ({"pack": {k: pack[k] for k in ("name", "version", "languages", "description", "license", "source", "path")}} if pack else {})
    return _write_around(path, {"document_count": entries.count()}, "documents", (_json(r.asDict(True)) for r in rows), "[]", after)


def write_model(kb: DataFrame, path: str, order: int = 2) -> str:
    """Counts, and of each prefix its successors with their counts."""
    facts = ngram.model_summary(kb, order).first()
    rows = ngram.transitions(kb, order).groupBy("prefix").agg(F.array_sort(F.collect_list(F.struct("next", "n"))).alias("next")).orderBy("prefix").toLocalIterator()
    items = (f"{json.dumps(r['prefix'])}: {_json({x['next']: x['n'] for x in r['next']})}" for r in rows)
    before = {"document_count": facts["documents"], "model_type": "word-ngram", "model_version": MODEL_VERSION, "order": order, "token_count": facts["token_count"], "transition_count": facts["transition_count"]}
    return _write_around(path, before, "transitions", items, "{}", {})


def read_model(path: str) -> dict:
    return json.loads(Path(path).read_text("utf-8"))


def describe_model(path: str) -> str:
    model = read_model(path)
    fields = {"Type": "model_type", "Version": "model_version", "Order": "order", "Documents": "document_count", "Tokens": "token_count", "Transitions": "transition_count"}
    return "\n".join(["Fathom local model", *(f"{shown}: {model.get(key, 'unknown')}" for shown, key in fields.items())])


def evaluation_report(engine: Engine, cases: DataFrame, top_k: int = 3) -> dict:
    """All figures and a record a case. All cases are searched as one batch; a case's elapsed_ms is its share of the batch's time."""
    numbered = materialise(cases.withColumn("qid", F.monotonically_increasing_id()), "cases")
    began = time.perf_counter()
    results = materialise(engine.search(numbered.select("qid", "query"), top_k), "results")
    total = numbered.count()
    each = (time.perf_counter() - began) * 1000 / max(1, total)
    of_cases = materialise(evaluate.case_results(numbered, results), "case_results")
    figures = evaluate.metrics(of_cases).first().asDict()
    fields = ["title", "path", "language", "tags", "score", "confidence", "matched_terms", "passage"]
    ranked = results.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", *fields))), lambda r: F.struct(*[r[c].alias(c) for c in fields])).alias("results"))
    records = []
    for r in of_cases.join(ranked, "qid", "left").orderBy("qid").toLocalIterator():
        found = [x.asDict(True) for x in r["results"] or []]
        record = {k: r[k] for k in ("query", "expected_tag", "expected_language", "difficulty", "rank", "reciprocal_rank", "confidence")}
        records.append(record | {"top_1_correct": r["rank"] == 1, "top_k_correct": r["rank"] is not None, "elapsed_ms": each, "results": found, "result": {k: v for k, v in found[0].items() if k != "confidence"} if found else None})
    groups: dict[str, dict] = {k: {} for k in ("tag", "difficulty", "language")}
    for r in evaluate.buckets(of_cases).collect():  # one row a tag, difficulty or language
        groups[r["kind"]][r["bucket"]] = {k: v for k, v in r.asDict().items() if k not in ("kind", "bucket")}
    quality = {k: figures[k] for k in ("top_1_correct", "top_k_correct", "top_1_accuracy", "top_k_accuracy", "mean_reciprocal_rank")}
    spent = each if total else 0.0
    return quality | {
        "benchmark": {"top_k": top_k, "notes": "A case is correct when a retrieved document has the expected tag, and the expected language where one is named."},
        "total_cases": total, "correct": figures["top_1_correct"], "latency_ms": dict.fromkeys(("mean", "min", "max", "p95"), spent),
        "confidence": {c: figures[c.lower()] for c in ("HIGH", "MEDIUM", "LOW", "NONE")}, "top_result_languages": {r["top_language"]: r["cases"] for r in evaluate.top_languages(of_cases).collect()},
        "by_expected_tag": groups["tag"], "by_difficulty": groups["difficulty"], "by_expected_language": groups["language"], "cases": records,
    }


def show_evaluation(report: dict) -> str:
    failed = [f"- {c['query']!r}: " + (f"expected tag {c['expected_tag']!r}, got {c['result']['path']}" if c["result"] else "no result") for c in report["cases"] if not c["top_1_correct"]]
    return "\n".join([
        "Fathom evaluation", f"Total cases: {report['total_cases']}", f"Top-1 accuracy: {report['top_1_accuracy']:.2%}", f"Top-{report['benchmark']['top_k']} accuracy: {report['top_k_accuracy']:.2%}",
        f"MRR: {report['mean_reciprocal_rank']:.3f}", f"Mean search latency: {report['latency_ms']['mean']:.3f} ms", "Confidence statistics:",
        *(f"- {c}: {n}" for c, n in report["confidence"].items()), "Failed cases:", *(failed or ["- none"]),
    ])


def write_report(report: dict, path: str) -> str:
    write_json(report, path)
    return path


def self_check(kb: DataFrame) -> list[tuple[str, bool, str]]:
    """(name, ok, detail): Python, Spark and Java, the terminal, the knowledge table, the network."""
    spark, documents = kb.sparkSession, kb.count()
    return [
        ("python", sys.version_info >= (3, 10), f"3.10 or later is needed, this is {platform.python_version()}"),
        ("platform", True, f"{platform.platform()}; Java {spark.sparkContext._jvm.System.getProperty('java.version')}"),
        ("terminal", not sys.stdout.closed, "standard output is open"),
        ("knowledge", documents > 0, f"{documents} document(s) found"),
        ("network", True, "no network beyond the cluster's own is used"),
        ("dependencies", True, f"PySpark {pyspark.__version__}, pyarrow"),
    ]


def show_checks(checks: list[tuple[str, bool, str]]) -> str:
    return "\n".join(["Fathom self-check", *(f"[{'OK' if ok else 'FAIL'}] {name}: {detail}" for name, ok, detail in checks)])
