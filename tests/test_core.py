import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from fathom.functions import chunking, text
from fathom.operators import answer, evaluate, ngram, packs, postings, rank
from fathom.sources import markdown, pdf

KB = "path string, title string, body string, language string, tags array<string>, priority string"
DOCS = [
    ("en/water.md", "Water", "Boil water for one minute. Let it cool before you drink it.", "en", ["water", "purification"], "high"),
    ("en/fire.md", "Fire", "Keep dry wood. Never leave a fire alone.", "en", [], "odd"),
    ("en/same1.md", "Radio", "Radio radio radio radio radio calls save phones.", "en", ["radio"], "low"),
    ("en/same2.md", "Radio", "Radio radio radio radio radio calls save phones.", "en", ["radio"], "low"),
    ("es/agua.md", "Agua", "Hierva el agua. El niño bebe después.", "es", ["agua"], "critical"),
    ("es/vacio.md", "", "", "unknown", [], "normal"),
]


@pytest.fixture(scope="module")
def kb(spark):
    return spark.createDataFrame(DOCS, KB).withColumn("source_sha256", F.sha2("body", 256))


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "qid long, query string")


def test_fold_matches_unicode(spark):
    rng = random.Random(1)
    pool = [chr(c) for c in (*range(32, 0x3000), *range(0xF900, 0xFFF0), 0x1D400, 0x1F100)]
    rows = [("".join(rng.choices(pool, k=20)),) for _ in range(500)] + [("",), ("ﬁ½ßŒ",)]
    for r in spark.createDataFrame(rows, "t string").select("t", text.fold(F.col("t")).alias("f")).collect():
        assert r["f"] == text.fold_text(r["t"]), [unicodedata.name(c, "?") for c in r["t"]]


def test_tokens_and_expansion(spark):
    r = spark.createDataFrame([("Las baterías cans, the Boxes",), (None,)], "t string").select(text.tokens(F.col("t")).alias("t"), text.expand(text.tokens(F.col("t"))).alias("e")).collect()
    assert r[0]["t"] == ["baterias", "cans", "boxes"] and r[0]["e"] == ["baterias", "bateria", "cans", "can", "boxes", "box"]
    assert r[1]["t"] == [] and r[1]["e"] == []
    assert chunking.expand_tokens(r[0]["t"]) == r[0]["e"]


def _lexical(query, doc, n):
    path, title, body, _, tags, priority = doc
    wanted, b = chunking.expand_tokens(chunking.tokenise(query)), chunking.tokenise(body)
    t, g = chunking.tokenise(title), chunking.tokenise(" ".join(tags))
    have = [w for w in wanted if w in b or w in t or w in g]
    s = sum((min(b.count(w), 4) + 3 * (w in t) + 2.5 * (w in g)) * (1 + min(len(w), 12) / 20) for w in wanted)
    s += 4 * (text.fold_text(query) in text.fold_text(f"{title} {' '.join(tags)} {body}"))
    s += math.log2(len(have) + 1) if len(have) > 1 else 0
    return s * rank.BOOSTS.get(priority, 1) / math.sqrt(len(b) + 20) * (1 + min(n, 100) / 500) if have else 0


def test_lexical_against_brute_force(spark, kb):
    queries = ["boil water", "radio calls save", "fire", "the", "", "niño agua"]
    got = {(r["qid"], r["path"]): r["score"] for r in rank.scored(asked(spark, *queries), kb).collect()}
    want = {(q, d[0]): s for q, words in enumerate(queries) for d in DOCS if (s := _lexical(words, d, len(DOCS))) > 0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_ties_go_by_path_and_language_filters_first(spark, kb):
    best = rank.search(asked(spark, "radio"), kb, "bm25").orderBy("rank").collect()
    assert [r["path"] for r in best] == ["en/same1.md", "en/same2.md"] and best[0]["score"] == best[1]["score"]
    assert rank.search(asked(spark, "agua"), kb, language="ES").select("path").collect()[0][0] == "es/agua.md"
    assert rank.search(asked(spark, "radio"), kb.limit(0)).count() == 0


def test_answers_refuse(spark, kb):
    q = asked(spark, "boil water", "zebra")
    rows = {r["qid"]: r for r in answer.answers(q, rank.search(q, kb)).collect()}
    assert rows[0]["accepted"] and "Follow-up checks:" in rows[0]["answer"] and answer.RULES[2][1][0] in rows[0]["answer"]
    assert not rows[1]["accepted"] and rows[1]["answer"].startswith(answer.REFUSAL)


def test_chunks():
    assert chunking.windows("One two. Three four. Five.", 20) == ["One two. Three four.", "Three four. Five."]
    assert chunking.units("- a b\n- c d\nplain") == ["a b", "c d", "plain"]
    assert all(len(w) <= 30 for w in chunking.windows("word " * 50, 30)) and chunking.windows("") == [""]


def test_hard_wrap_column_matches_loop(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choices("ab  c", k=80)).strip(),) for _ in range(200)]
    for r in spark.createDataFrame(rows, "t string").select("t", chunking.hard_wrap(F.col("t"), 20).alias("p")).collect():
        assert r["p"] == chunking.wrap(r["t"], 20)


def test_index_model_and_walk(spark, kb):
    row = postings.audit_index(kb).filter("path = 'en/same1.md'").first()
    assert row["terms"]["radio"] == 7 and row["token_count"] == 10
    assert ngram.walk("alpha beta gamma alpha beta delta", "alpha beta") == "alpha beta gamma alpha beta" and ngram.walk("one two", "one") == ""
    with pytest.raises(ValueError):
        ngram.transitions(kb, 0)


def test_evaluation(spark, kb):
    cases = spark.createDataFrame([(0, "radio", "radio", "direct", None), (1, "zebra", "water", "direct", "en")], "qid long, query string, expected_tag string, difficulty string, expected_language string")
    of = evaluate.case_results(cases, rank.search(cases.select("qid", "query"), kb))
    m = evaluate.metrics(of).first()
    assert (m["total"], m["top_1_correct"], m["none"], m["mean_reciprocal_rank"]) == (2, 1, 1, 0.5)
    assert {(r["kind"], r["bucket"]) for r in evaluate.buckets(of).collect()} == {("tag", "radio"), ("tag", "water"), ("difficulty", "direct"), ("language", "unspecified"), ("language", "en")}
    for n, want in ((0, 0), (1, 1), (20, 20), (40, 39)):
        assert evaluate.latency_summary(spark.createDataFrame([(float(k),) for k in range(1, n + 1)], "v double"), "v").first()["p95"] == want


def test_validation_and_listing(spark, kb):
    found = {(r["severity"], r["message"]) for r in packs.validate_pack(kb, {}).collect()}
    assert ("error", "missing manifest") in found and ("warning", "2 document(s) do not declare tags") in found
    assert packs.list_knowledge(kb).first()["path"] == "en/fire.md"


def test_sources(spark, tmp_path):
    (tmp_path / "en" / "deep").mkdir(parents=True)
    (tmp_path / "en/a-b_c.md").write_bytes(b"---\r\ntitle: T\r\ntags:\r\n- x\r\n- y\r\nlanguage: en\r\n---\r\nBody\r\n")
    (tmp_path / "en/deep/my-file_name.md").write_text("no heading")
    (tmp_path / "en/c.txt").write_text("no")
    rows = {r["path"]: r for r in markdown.read_knowledge(spark, str(tmp_path)).collect()}
    assert rows.keys() == {"en/a-b_c.md", "en/deep/my-file_name.md"}
    assert rows["en/a-b_c.md"]["tags"] == ["x", "y"] and rows["en/a-b_c.md"]["body"] == "Body" and rows["en/deep/my-file_name.md"]["title"] == "My File Name"
    one, two = (markdown.export_pack(str(tmp_path), str(tmp_path / n)) for n in ("1.zip", "2.zip"))
    assert open(one, "rb").read() == open(two, "rb").read()
    assert {r["path"] for r in markdown.read_knowledge(spark, one).collect()} == {"1.zip:en/a-b_c.md", "1.zip:en/deep/my-file_name.md"}
    assert markdown.read_knowledge(spark, str(tmp_path / "none")).count() == 0


def test_pdf_text(spark):
    rows = spark.createDataFrame([("a", "Always boil unsafe water first.\nALWAYS BOIL UNSAFE WATER FIRST.\nNever drink from a flooded well today.")], "path string, text string")
    got = [(r["rank"], r["score"]) for r in pdf.important_points(rows).orderBy("rank").collect()]
    assert got == [(1, 5)]  # "boil" is no verb of the list; "Never drink" is, and forbids


def test_session(spark, kb):
    from fathom.streaming.session import session_turns

    turns = spark.createDataFrame([(1, 0, "boil water"), (1, 1, "what about fire"), (2, 0, "zebra"), (2, 1, "and then?"), (None, 0, "x"), (3, 0, None)], "conv_id long, turn long, text string")
    rows = {(r["conv_id"], r["turn"]): r for r in session_turns(turns, lambda q: rank.search(q, kb))[0].collect()}
    assert len(rows) == 4 and rows[1, 1]["searched"].startswith("boil water Water water purification") and rows[2, 1]["searched"] == "and then?"


def test_shared_folder_needs_a_name_on_a_cluster():
    from fathom.plans.shared import shared_folder

    class Context:
        master, applicationId = "spark://host:7077", "app"
        getConf = lambda self: {}

    class Session:
        conf, sparkContext = type("Conf", (), {"get": staticmethod(lambda name, default: default)}), Context()

    with pytest.raises(RuntimeError):
        shared_folder(Session())


def test_line_ends_and_hidden_files(spark, tmp_path):
    import zipfile

    (tmp_path / "kb/.h").mkdir(parents=True)
    (tmp_path / "kb/.h/one.md").write_text("# One\n\ntext")
    (tmp_path / "kb/_two.md").write_text("---\ntitle: Two\n---\nbody")
    (tmp_path / "kb/three.md").write_text("three")
    rows = {r["path"]: r for r in markdown.read_knowledge(spark, str(tmp_path / "kb")).collect()}
    assert rows.keys() == {".h/one.md", "_two.md", "three.md"} and rows[".h/one.md"]["title"] == "One" and rows["_two.md"]["title"] == "Two"
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as pack:
        pack.writestr("a.md", b"---\r\ntitle: T\r\ntags:\r\n- x\r\n---\r\nPara one.\r\n\r\nPara two.\r\n")
    row = markdown.read_knowledge(spark, str(tmp_path / "p.zip")).first()
    assert row["body"] == "Para one.\n\nPara two." and row["title"] == "T" and row["tags"] == ["x"]
    assert markdown.front_matter("") == {"meta": {}, "listed": [], "body": ""}


def test_index_hashes_the_whole_source_and_files(spark, tmp_path):
    import hashlib
    import json

    from fathom.plans import reports

    text = "---\ntitle: T\nlanguage: en\n---\nwater water boil"
    (tmp_path / "kb/en").mkdir(parents=True)
    (tmp_path / "kb/en/a.md").write_text(text)
    (tmp_path / "kb/pack.json").write_text(json.dumps({"name": "n", "version": "1", "languages": None, "license": "l", "source": "s"}))
    kb = markdown.read_knowledge(spark, str(tmp_path / "kb"))
    assert postings.audit_index(kb).first()["source_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    pack = markdown.describe_pack(kb, str(tmp_path / "kb"))
    assert pack["languages"] == []
    path = reports.write_index(kb, str(tmp_path / "out/index.json"), pack)
    said = open(path).read()
    index = json.loads(said)
    assert said == json.dumps(index, indent=2, sort_keys=True) + "\n"
    assert (index["index_version"], index["document_count"], index["term_count"], index["pack"]["name"]) == (1, 1, 2, "n") and index["documents"][0]["terms"] == {"boil": 1, "water": 2}
    path = reports.write_model(kb, str(tmp_path / "model.json"), 1)
    model = json.loads(open(path).read())
    assert open(path).read() == json.dumps(model, indent=2, sort_keys=True) + "\n" and model["transitions"] == {"water": {"boil": 1, "water": 1}} and model["transition_count"] == 1
    assert "Transitions: 1" in reports.describe_model(path)
    checks = reports.self_check(kb)
    assert all(ok for _, ok, _ in checks) and "[OK] knowledge: 1 document(s) found" in reports.show_checks(checks)
    assert not all(ok for _, ok, _ in reports.self_check(kb.limit(0)))


def test_pack_without_manifest_has_only_that_error(spark, kb):
    assert [r["message"] for r in packs.validate_pack(kb, {}).collect() if r["severity"] == "error"] == ["missing manifest"]


def test_evaluation_report(spark, kb, tmp_path):
    import json

    from fathom.plans import reports
    from fathom.plans.engine import Engine

    cases = spark.createDataFrame([("radio", "radio", "direct", None), ("zebra", "water", "standard", "en")], "query string, expected_tag string, difficulty string, expected_language string")
    report = reports.evaluation_report(Engine(kb), cases)
    assert report["total_cases"] == 2 and report["correct"] == 1 and report["by_expected_language"].keys() == {"en", "unspecified"} and report["confidence"]["NONE"] == 1
    assert report["cases"][0]["result"]["path"] == "en/same1.md" and report["cases"][1]["result"] is None and report["top_result_languages"] == {"NONE": 1, "en": 1}
    assert "- 'zebra': no result" in reports.show_evaluation(report)
    assert json.loads(open(reports.write_report(report, str(tmp_path / "r.json"))).read())["total_cases"] == 2
    empty = reports.evaluation_report(Engine(kb), cases.limit(0))
    assert empty["total_cases"] == 0 and empty["latency_ms"]["p95"] == 0.0 and empty["cases"] == []


def test_stored_postings_rank_the_same(spark, kb):
    q = asked(spark, "boil water", "radio", "the")
    one, two = (sorted(map(tuple, rank.scored(q, kb, kind, stored).collect())) for kind, stored in (("bm25", None), ("bm25", rank.postings(kb))))
    assert one == two
    every = {(r["qid"], r["path"]): r["score"] for r in rank.scored(q, kb).collect()}
    best = {(r["qid"], r["path"]): r["score"] for r in rank.top(rank.scored(q, kb, top_k=1), 1).collect()}
    assert best and all(every[k] == v for k, v in best.items())


def test_console_forgets(spark, kb, capsys):
    import argparse

    from fathom.cli import console
    from fathom.plans.engine import Engine

    lines = iter(["boil water", "", "what about fire", "clear", "what about fire", "exit"])
    assert console(Engine(kb), argparse.Namespace(top_k=3), lambda _: next(lines)) == 0
    said = capsys.readouterr().out
    assert "Context cleared." in said and said.count("CONFIDENCE]") == 3
    first, second = said.split("Context cleared.")
    assert "Title: Water" in first.split("> ")[-1] or "Title: Water" in first
    assert "Title: Fire" in second  # without the context it is about fire alone


def test_page_and_history(spark, kb):
    from fathom import web
    from fathom.plans.engine import Engine
    from fathom.streaming.session import Session

    assert web.parameter("q=a%20b+c&clear=1", "q") == "a b c" and web.parameter("x=1", "q") == ""
    shown = web.page("<q>", [(f"q{k}", "<a>") for k in range(6)]).decode()
    assert "&lt;q&gt;" in shown and "q1" not in shown and shown.count("<section>") == 4
    session = Session(Engine(kb))
    assert session.passage("boil water").startswith("Boil water") and session.context.startswith("boil water Water")
    assert session.passage("zebra") == answer.REFUSAL and session.context.startswith("boil water Water")
    session.clear()
    assert session.context is None
    rows = spark.createDataFrame([(1, k, "u", f"t{k}<") for k in range(6)], "conv_id long, turn long, role string, text string")
    html = web.history_html(rows, F.col("role"), F.col("text")).first()["html"]
    assert html.startswith("<section><h2>u</h2><pre>t2&lt;</pre>") and html.count("<section>") == 4


def test_stream_of_sessions(spark, kb, tmp_path):
    from fathom.streaming.session import run_sessions

    shape = "conv_id long, turn long, text string"
    for k, row in enumerate([(1, 0, "boil water"), (1, 1, "what about fire"), (1, 2, "and then?")]):
        spark.createDataFrame([row], shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
        run_sessions(stream, lambda q: rank.search(q, kb), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    rows = {r["turn"]: r["searched"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows[0] == "boil water" and rows[1].startswith("boil water Water") and rows[2].endswith("and then?") and rows[2] != "and then?"
    assert sorted(p.name for p in (tmp_path / "check/memory").iterdir() if p.name.isdigit()) == ["1", "2"]


def test_chunk_column_matches_loop(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choices(["ab. ", "c", "dd ", "\n\n", "! ", "x" * 9], k=rng.randint(0, 60))),) for _ in range(150)] + [("",), (" \n\n ",), (None,)]
    for r in spark.createDataFrame(rows, "t string").select("t", chunking.chunked(F.col("t"), 20).alias("c")).collect():
        assert r["c"] == (None if r["t"] is None else chunking.chunks(r["t"], 20)), r["t"]


def test_pdf_document(spark):
    pages = spark.createDataFrame([("/x/my_file.pdf", "ab", 1, "Water Safety\nAlways boil unsafe water before you drink any of it."), ("/x/my_file.pdf", "ab", 2, "ok")], "path string, source_sha256 string, page int, text string")
    said = pdf.document_to_markdown(pages, language="en", tags=("a", "b")).first()["markdown"]
    assert said.startswith("---\ntitle: Water Safety\nlanguage: en\ntags:\n  - a\n  - b\npriority: normal\nsource_type: pdf\nsource_file: my_file.pdf\nsource_sha256: ab\npages: 2\n---\n\n## Important Points\n\n- Always boil")
    assert "## Extracted Text\n\n### Page 1\n\n### Water Safety\n" in said and said.endswith("### Page 2\n\nok\n")
    plain = pdf.document_to_markdown(pages.withColumn("text", F.lit("ok"))).first()["markdown"]
    assert "title: My File\n" in plain and "  - imported\n" in plain and "No high-signal" in plain


def test_export_gate_and_digest(spark, tmp_path, capsys):
    from fathom.cli import main

    (tmp_path / "kb").mkdir()
    (tmp_path / "kb/a.md").write_text("text")
    assert main(["--source", str(tmp_path / "kb"), "--export", str(tmp_path / "p.zip"), "--require-valid"]) == 1 and "ERROR: missing manifest" in capsys.readouterr().out
    assert main(["--source", str(tmp_path / "kb"), "--export", str(tmp_path / "p.zip")]) == 0
    assert f"SHA-256: {markdown.file_digest(str(tmp_path / 'p.zip'))}" in capsys.readouterr().out
    assert main(["--source", str(tmp_path / "kb"), "--list"]) == 0 and "unknown | normal | A | none | a.md" in capsys.readouterr().out
    assert main(["--import-pdf", str(tmp_path / "none.pdf")]) == 1


def test_engine_takes_any_strategy(spark, kb):
    from fathom.plans.engine import Engine

    q = asked(spark, "radio")
    assert Engine(kb, "no such").search(q).count() == Engine(kb).search(q).count() == 2

    class Nothing:
        def search(self, queries, kb, top_k, language, stored):
            return rank.search(queries, kb.limit(0))

    assert Engine(kb, Nothing()).answer(q).first()["accepted"] is False


def test_search_lets_out_contenders_only(spark, monkeypatch):
    rng = random.Random(7)
    docs = [(f"en/{k:04}.md", "T", " ".join(["common", *rng.choices("ab cd ef gh ij".split(), k=rng.randint(0, 9))]), "en", [], "normal") for k in range(300)]
    kb = spark.createDataFrame(docs, KB)
    q = asked(spark, *[f"common {a} {b}" for a in "ab cd ef".split() for b in "gh ij".split()])
    pairs = rank.scored(q, kb).count()
    want = sorted(map(tuple, rank.top(rank.scored(q, kb), 2).select("qid", "path", "score", "rank").collect()))
    written = {}
    keep = lambda df, name: written.setdefault(name, rank_materialise(df, name))
    rank_materialise = rank.materialise
    monkeypatch.setattr(rank, "materialise", keep)
    for groups, wanted in ((rank.GROUP_TERMS, rank.MOST_WANTED), (7, 0)):  # one group, or a few; only what is asked for, or all
        monkeypatch.setattr(rank, "GROUP_TERMS", groups)
        monkeypatch.setattr(rank, "MOST_WANTED", wanted)
        written.clear()
        assert sorted(map(tuple, rank.top(rank.scored(q, kb, top_k=2), 2).select("qid", "path", "score", "rank").collect())) == want
        assert max(t.count() for t in written.values()) < pairs / 2  # 1,800 pairs


def test_batch_tokens_match_loop():
    import pyarrow as pa

    from fathom.functions import batches

    rng = random.Random(3)
    pool = [chr(c) for c in (*range(0x3000), *range(0xF900, 0xFFF0), 0xAC00, 0x1D400, 0x1F100)] + list("ab XY 09") * 300
    rows = ["".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(500)] + [None, "", "the a", " x", "ab"]
    words, begins = batches.flat_tokens(pa.array(rows))
    assert batches.listed(begins, words).to_pylist() == [chunking.tokenise(r or "") for r in rows]
    assert [len(p) for p in batches.slices(pa.record_batch([pa.array(["aaa", None, "a", "aaaa", ""])], ["t"]), 4)] == [2, 1, 2]


def test_pdf_text_is_shuffled_once(spark):
    pages = spark.createDataFrame([("a.pdf", "ab", 1, "x")], "path string, source_sha256 string, page int, text string")
    plan = pdf.document_to_markdown(pages)._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and plan.count("ObjectHashAggregate") + plan.count("SortAggregate") <= 2  # one aggregation, in two steps
    assert pdf.clean_text("\ta \t b\r\n\r\xa0\n \x0bc  ") == "a b\nc"
    rows = spark.createDataFrame([("\n\nTwo\n\n\n one ", "x"), (None, "y")], "body string, path string").select("path", F.inline(pdf.paged(2)("body"))).collect()
    assert [tuple(r) for r in rows] == [("x", 2, "Two"), ("x", 3, "one")]
    twice = spark.createDataFrame([("a", "Never drink from a flooded well."), ("a", "NEVER DRINK FROM A FLOODED WELL.\nAvoid all of the flooded wells here.")], "path string, text string")
    assert sorted((r["rank"], r["sentence"]) for r in pdf.important_points(twice).collect()) in ([(1, "Never drink from a flooded well."), (2, "Avoid all of the flooded wells here.")], [(1, "NEVER DRINK FROM A FLOODED WELL."), (2, "Avoid all of the flooded wells here.")])


def test_term_statistics_in_one_pass(spark, kb):
    stats = postings.corpus_stats(kb)
    plans = [d._jdf.queryExecution().sparkPlan().toString() for d in (stats, postings.audit_index(kb))]
    assert not any(w in p for p in plans for w in ("Join", "CartesianProduct", "Expand"))
    r = stats.first()
    every = [chunking.tokenise(f"{d[1]} {' '.join(d[4])} {d[2]}") for d in DOCS]
    lengths = [3 * len(chunking.tokenise(d[1])) + 2 * len(chunking.tokenise(" ".join(d[4]))) + len(chunking.tokenise(d[2])) for d in DOCS]
    assert (r["documents"], r["tokens"], r["terms"]) == (len(DOCS), sum(map(len, every)), len({t for e in every for t in e}))
    assert r["mean_length"] == round(sum(lengths) / len(DOCS), 6)
    assert tuple(postings.corpus_stats(kb.limit(0)).first()) == (0, None, 0, 0)
    twice = kb.filter("path = 'es/agua.md'")
    rows = postings.audit_index(twice.union(twice)).collect()  # texts of one path count together, and each row stays
    assert len(rows) == 2 and all((r["token_count"], r["terms"]) == (14, {"agua": 6, "bebe": 2, "despues": 2, "hierva": 2, "nino": 2}) for r in rows)


def test_grams_are_counted_before_the_shuffle(spark, kb):
    from collections import Counter

    for order in (1, 2, 3):
        every = [chunking.tokenise(f"{d[1]} {' '.join(d[4])} {d[2]}") for d in DOCS]
        want = Counter((" ".join(t[k : k + order]), t[k + order]) for t in every for k in range(len(t) - order))
        found = ngram.transitions(kb, order)
        assert {(r["prefix"], r["next"]): r["n"] for r in found.collect()} == want
        assert "Generate" not in found._jdf.queryExecution().sparkPlan().toString()  # no row a place in a text
        assert tuple(ngram.model_summary(kb, order).first()) == (order, len(DOCS), sum(map(len, every)), len({p for p, _ in want}), len(want))
    long = spark.createDataFrame([("a", "", " ".join(f"w{k}" for k in range(9000)), "en", [], "x")] * 2, KB)  # numbers of six of 9,000 tokens don't fit
    assert {r["n"] for r in ngram.transitions(long, 5).collect()} == {2} and ngram.transitions(long, 5).count() == 8995
    assert tuple(ngram.model_summary(kb.limit(0)).first()) == (2, 0, 0, 0, 0)


def test_matches_are_counted_in_batches(spark, kb):
    rows = spark.createDataFrame([("Wet wet Dogs the é", "dogs, wet é"), ("one", None), (None, "one"), ("x one", "two one"), ("", "")], "a string, b string")
    found = rows.select(postings.count_matches("a", "b").alias("n"))
    assert [r["n"] for r in found.collect()] == [3, 0, 0, 1, 0] and "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()
    assert ngram.transitions(kb).count() and rank.postings(kb).count() == len(DOCS)  # a function that was called isn't pickled with theirs


def test_front_matter_alone_goes_through_python(spark):
    space = " \t　\x85"
    texts = ["---\ntitle: T\n---\nbody\r\nmore\n", f"{space[:3]}--- \r\n- x\ntags:\n- a\n　---\xa0\n\n# H\x0bz ", "---\nno end", "\n---\na: b\n---\n", "---", "---\n---", "---\n---\nx", "--- x\n---\n", "-----\n---\nb", "---\r---\rb\rc", "---\x1c a: b ---\x85c", "", space, "# One\n\n---\n", f"{space}x{space}", None, "--\n---\nt\n---", "---\nkey: v\n ---x\n---\n  z  \n"]
    rows = spark.createDataFrame([(f"f{k}.md", t) for k, t in enumerate(texts)], "path string, text string")
    found = markdown.documents_of(rows)
    for k, r in enumerate(sorted(found.collect(), key=lambda r: int(r["path"][1:-3]))):
        want = markdown.front_matter(texts[k] or "")
        assert (r["body"], r["metadata"]) == (want["body"], want["meta"]), texts[k]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_split(head" in plan and "_split(text" not in plan


def test_strip_column_matches_python(spark):
    rng = random.Random(8)
    rows = [("".join(rng.choices([chr(c) for c in range(0x3001) if chr(c).isspace()] + ["a", "​", "é"], k=rng.randint(0, 9))),) for _ in range(400)]
    assert all(r["s"] == r["t"].strip() for r in spark.createDataFrame(rows, "t string").select("t", chunking.strip(F.col("t")).alias("s")).collect())


def test_chunks_are_packed_in_batches(spark):
    found = spark.createDataFrame([("a. " * 300,)], "t string").select(chunking.chunked(F.col("t")).alias("c"))
    assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString() and [len(c) for c in found.first()["c"]] == [698, 200]


def test_session_makes_accepted_passages_only(spark, kb):
    from fathom.streaming.session import session_turns

    turns = spark.createDataFrame([(1, 0, "boil water"), (1, 1, "what about fire"), (2, 0, "zebra")], "conv_id long, turn long, text string")
    one, two = (sorted(map(tuple, session_turns(turns, lambda q, w=w: rank.search(q, kb, passages=w))[0].collect())) for w in (True, False))
    assert one == two and [r[5][:10] for r in one] == ["Boil water", "Boil water", answer.REFUSAL[:10]]
