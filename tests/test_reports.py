"""Reports, engines, providers, the corpus, settings and the command line."""

import json
import logging
import sys
from dataclasses import replace

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gleaner import cli, engines
from gleaner.exceptions import AnalysisError, ConfigurationError, CorruptIndexError, GleanerError, IndexingError, IngestionError
from gleaner.functions.text import result_url, starts, two_digits
from gleaner.logs import setup_logging
from gleaner.operators import chunk, matching, stylometry
from gleaner.plans import analysis, reports
from gleaner.plans.pipeline import AnalysisPipeline
from gleaner.settings import Settings
from gleaner.sources import corpus, documents, providers, web

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests
TEXT = "The quick brown fox jumps over the lazy dog near the old river bank today."
KEYS = {
    "": {"schema_version", "document_id", "version", "status", "plagiarism", "ai_likelihood", "generated_at", "document", "summary", "caveats"},
    "document": {"source_path", "filename", "file_format", "character_count"},
    "summary": {"analyses_run", "plagiarism_match_count", "plagiarism_overall_score", "ai_likeness_score", "automated_writing_risk", "human_review_recommended"},
    "plagiarism": {"document_id", "matches", "overall_score", "match_count"},
    "plagiarism.matches.0": {"finding_id", "source", "similarity_score", "matched_excerpt", "source_excerpt", "match_type", "offsets"},
    "plagiarism.matches.0.source": {"source_id", "source_label", "source_path", "chunk_index", "modified_at"},
    "plagiarism.matches.0.offsets": {"start", "end", "unit", "basis", "end_exclusive"},
    "ai_likelihood": {"document_id", "indicators", "chunk_findings", "ai_likeness_score", "automated_writing_risk", "signals_triggered", "human_review_recommended", "disclaimer", "caveats"},
    "ai_likelihood.indicators.0": {"signal_name", "value", "description", "triggered"},
    "ai_likelihood.chunk_findings.0": {"finding_id", "chunk_index", "ai_likeness_score", "signals", "signals_triggered", "explanation"},
    "ai_likelihood.caveats.0": {"code", "message", "severity", "scope"},
    "ai_likelihood.chunk_findings.0.signals": set(stylometry.WEIGHTS),
}


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "document_id string, text string")


def sources(spark, *texts):
    return chunk.paragraphs(docs(spark, *texts)).withColumnRenamed("document_id", "source_id")


def at(tree, path):
    for k in path.split(".") if path else ():
        tree = tree[int(k)] if k.isdigit() else tree[k]
    return tree


def test_json_reports_have_every_key(spark):
    made = analysis.report(docs(spark, TEXT, ""), sources(spark, TEXT))
    got = {r["document_id"]: json.loads(r["report"]) for r in reports.as_json(made).collect()}
    for path, keys in KEYS.items():
        assert set(at(got["d0"], path)) == keys, path
    assert got["d0"]["plagiarism"]["matches"][0]["match_type"] == "exact" and got["d0"]["plagiarism"]["matches"][0]["source"]["modified_at"] is None
    assert [c["code"] for c in got["d0"]["caveats"]] == ["stylometric_only", "short_document"]
    empty = got["d1"]
    assert empty["ai_likelihood"]["document_id"] == "unknown" and empty["ai_likelihood"]["indicators"] == empty["caveats"] == empty["plagiarism"]["matches"] == []
    assert "not proof" in got["d0"]["ai_likelihood"]["disclaimer"]


def test_analyses_that_are_not_run_are_null(spark):
    made = analysis.report(docs(spark, TEXT), None, run_plagiarism=False, run_ai_check=False)
    got = json.loads(reports.as_json(made).first()["report"])
    assert got["plagiarism"] is got["ai_likelihood"] is None and got["summary"]["automated_writing_risk"] == "none" and got["summary"]["analyses_run"] == []
    assert "analyses=none" in reports.as_text(made).first()["report"]


def test_text_reports_show_ten_matches_and_each_caveat_once(spark):
    made = analysis.report(docs(spark, TEXT), sources(spark, *[TEXT] * 13))
    got = reports.as_text(made).first()["report"]
    assert got.count("[exact] score=1.00") == 10 and "... and 3 more" in got and "13 match(es)" in got
    assert got.count("[stylometric_only]") == got.count("[short_document]") == 1 and "Report caveats" not in got
    own = made.withColumn("caveats", F.concat("caveats", F.array(F.struct(*[F.lit(x).alias(k) for k, x in (("code", "c"), ("message", "m"), ("severity", "info"), ("scope", "report"))]))))
    assert reports.as_text(own).first()["report"].endswith("Report caveats:\n  - [c] m")


def test_matches_are_ranked_with_ties_by_source(spark):
    found = reports.plagiarism_sections(matching.merge(matching.matches(chunk.paragraphs(docs(spark, TEXT)), sources(spark, TEXT, "x " + TEXT, TEXT))), docs(spark, TEXT)).first()["plagiarism"]
    assert [m["source"]["source_id"] for m in found["matches"]] == ["d0", "d2", "d1"]


def test_what_signals_say():
    for high, low in stylometry.TOLD.values():
        assert "normal range" not in high and "natural" not in high
        assert any(w in low for w in ("normal", "typical", "varied", "natural"))


def test_two_digits_as_python_writes_them(spark):
    values = [k / 10000 for k in range(0, 10001, 5)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", two_digits(F.col("v")).alias("t")).collect()
    assert all(r["t"] == f"{r['v']:.2f}" for r in got)


def test_running_sums_of_long_arrays(spark):
    got = spark.range(1).select(starts(F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda x: (x % 7).cast("int"))).alias("s")).first()["s"]
    total, expected = 0, []
    for i in range(1, 40_001):
        expected.append(total)
        total += i % 7
    assert got == expected
    assert spark.range(1).select(starts(F.array().cast("array<int>")).alias("s")).first()["s"] == []


def test_a_text_of_many_sentences_is_cut_in_linear_time(spark):
    n = 100_000
    got = chunk.sentences(docs(spark, "Ab é cd. " * n)).agg(F.count("*"), F.max("end_offset"), F.max("chunk_index")).first()
    assert tuple(got) == (n, 9 * n - 1, n - 1)


def test_links_of_results(spark):
    said = {
        "/l/?kh=1&uddg=https%253A%252F%252Fa.b%252F": "https://a.b/", "//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.b": "https://a.b", "/y?uddg=https%3A%2F%2Fa.b": None,
        "https://notduckduckgo.com/x": None, "/l/?uddg=%ZZ": None, "https://a.b/%ZZ": "https://a.b/%ZZ", "": None, "mailto:x": None, "/l/?uddg=https%3A%2F%2Fa.b%2Fx%2By": "https://a.b/x+y",
    }
    got = spark.createDataFrame([(k,) for k in said], "u string").select("u", result_url(F.col("u")).alias("t")).collect()
    assert {r["u"]: r["t"] for r in got} == said


ANSWERS = {
    "api.openalex.org": json.dumps({"results": [{"id": "W1", "display_name": "Fox", "primary_location": None, "abstract_inverted_index": {w: [i] for i, w in enumerate("a b c".split())}}, {"doi": "D", "open_access": {"oa_url": "https://full/x"}}]}),
    "api.crossref.org": json.dumps({"message": {"items": [{"DOI": "10.1/x", "title": ["T"], "abstract": f"<p>{TEXT}</p>"}]}}),
    "export.arxiv.org": "<feed broken",
    "html.duckduckgo.com": '<a class="result__a" href="/l/?uddg=https%3A%2F%2Ffull%2Fy">Y</a><a class="result__a" href="/about">no</a>',
    "full": f"<html><p>{TEXT}</p></html>",
}


def fake(url, accept):
    host = url.split("/")[2]
    if host == "full" and url.endswith("x"):
        raise OSError("down")
    return "text/html", ANSWERS[host].encode()


def test_remote_sources_are_found_resolved_and_compared(spark):
    settings = Settings(contact_email="me@x.org")
    asked = providers.default_providers(settings, fake)
    assert [p.name for p in asked] == ["openalex", "crossref", "arxiv", "duckduckgo"] and all(isinstance(p, providers.Provider) for p in asked)
    found = providers.search(matching.search_queries(chunk.paragraphs(docs(spark, TEXT))), asked, settings)
    assert sorted(r["source_id"] for r in found.collect()) == ["crossref:10.1/x", "duckduckgo:https://full/y", "openalex:D", "openalex:W1"]
    texts = {r["source_id"]: r["text"] for r in providers.resolve(found, asked, settings).collect()}
    assert texts == {"crossref:10.1/x": TEXT, "duckduckgo:https://full/y": TEXT} or set(texts) == {"crossref:10.1/x", "duckduckgo:https://full/y"}
    engine = engines.RemotePlagiarismEngine(settings, asked)
    got = engine.analyze(chunk.paragraphs(docs(spark, TEXT, "Other words that have nothing in common with the rest of it."))).collect()
    engine.close()
    assert {(r["document_id"], r["source_id"]) for r in got} == {("d0", "crossref:10.1/x"), ("d0", "duckduckgo:https://full/y")}
    assert engines.RemotePlagiarismEngine(settings, []).analyze(chunk.paragraphs(docs(spark, TEXT))).count() == 0


def test_arxiv_entries(spark):
    feed = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>i</id><title> a\n b </title><summary>s</summary><link href="x"/><link title="pdf" href="p"/></entry><entry/></feed>'
    rows = spark.createDataFrame([("d", 1, feed), ("d", 2, "<")], "document_id string, query_rank int, payload string")
    got = web.arxiv_candidates(rows).orderBy("result_rank").collect()
    assert [(r["source_id"], r["source_label"], r["metadata_text"], r["full_text_url"]) for r in got] == [("arxiv:i", "a b", "a b\n\ns", "p"), ("arxiv:", "arXiv work", "", None)]


def test_headers():
    assert providers.headers("x", "me@x.org")["User-Agent"].endswith("(me@x.org)") and providers.headers("x")["Accept"] == "x"


def test_table_provider_and_unknown_providers(spark):
    table = spark.createDataFrame([("a", TEXT), ("b", "nothing like it at all")], "source_id string, text string")
    own = providers.TableProvider("t", table)
    found = providers.search(matching.search_queries(chunk.paragraphs(docs(spark, TEXT))), [own])
    assert [r["source_id"] for r in found.collect()] == ["t:a"]
    assert providers.resolve(found, []).count() == 0 and providers.resolve(found, [own]).count() == 1


def files(spark, *rows):
    return spark.createDataFrame(rows, "document_id string, source_path string, modified_at timestamp, text string")


def test_corpus_versions(spark, tmp_path):
    from datetime import datetime

    folder, day = str(tmp_path / "c"), lambda n: datetime(2026, 1, n)
    assert corpus.load(spark, folder) is None
    corpus.save(folder, *corpus.indexed(files(spark, ("a", "/x/a.txt", day(1), TEXT), ("b", "/x/b.txt", day(1), "old"))))
    sources, chunks = corpus.load(spark, folder, Settings())
    now = files(spark, ("a", "/x/a.txt", day(1), "ignored"), ("b", "/x/b.txt", day(2), None), ("c", "/x/c.txt", day(2), "new text"))
    new_sources, new_chunks, state = corpus.refreshed(now, sources, chunks)
    assert corpus.stats(now, state) == corpus.IndexStats(1, 1, 1, 3)
    corpus.save(folder, new_sources, new_chunks)  # onto the folder that it is read from
    sources, chunks = corpus.load(spark, folder)
    assert sorted(r["label"] for r in sources.collect()) == ["a.txt", "c.txt"] and {r["text"] for r in chunks.collect()} == {TEXT, "new text"}
    (tmp_path / "c" / "v9").mkdir()  # a writer that failed
    assert corpus.load(spark, folder)[0].count() == 2
    with pytest.raises(CorruptIndexError, match="shingles"):
        corpus.load(spark, folder, Settings(shingle_size=3))
    spark.range(1).write.mode("overwrite").parquet(f"{folder}/v2/chunks")
    with pytest.raises(CorruptIndexError, match="schema"):
        corpus.load(spark, folder)
    with pytest.raises(IndexingError):
        corpus.save(f"file://{tmp_path}/c/v1/meta/_SUCCESS", sources, chunks)


def test_json_index_round_trip_and_errors(spark, tmp_path):
    path = str(tmp_path / "index.json")
    assert corpus.import_json(spark, path) is None
    corpus.save(path, *corpus.indexed(files(spark, ("a", "/x/a.txt", None, TEXT))))
    data = json.loads((tmp_path / "index.json").read_text())
    assert data["version"] == "3" and data["chunk_count"] == 1 and data["inverted"]["entries"]["the quick brown fox jumps"] == [{"source_idx": 0, "chunk_idx": 0}]
    sources, chunks = corpus.load(spark, path)
    assert matching.matches(chunk.paragraphs(docs(spark, TEXT)), corpus.matchable(sources, chunks)).first()["source_label"] == "a.txt"
    del data["inverted"], data["sources"][0]["source_id"]
    (tmp_path / "index.json").write_text(json.dumps(data | {"version": "2"}))
    assert corpus.load(spark, path)[1].count() == 1
    for bad, said in (("{", "not valid JSON"), ("[]", "invalid schema"), ('{"sources": 3}', "invalid schema"), ('{"sources": [{"label": "x"}]}', "invalid schema"), ('{"sources": [{"label": "x", "source_path": "y", "modified_at": 3}]}', "invalid schema")):
        (tmp_path / "index.json").write_text(bad)
        with pytest.raises(CorruptIndexError, match=said):
            corpus.load(spark, path)


def test_engines_follow_their_protocols(spark):
    local = engines.LocalPlagiarismEngine(spark, sources=sources(spark, TEXT))
    both = engines.HybridPlagiarismEngine(engines.NoPlagiarismEngine(), local)
    for e in (local, both, engines.NoPlagiarismEngine(), engines.RemotePlagiarismEngine(providers=[])):
        assert isinstance(e, engines.PlagiarismEngine)
    assert isinstance(engines.NoAiEngine(), engines.AiLikelihoodEngine) and isinstance(engines.NoSourceIndexer(), engines.SourceIndexer)
    chunks = chunk.paragraphs(docs(spark, TEXT))
    assert both.analyze(chunks).count() == 1 and engines.NoPlagiarismEngine().analyze(chunks).count() == 0
    row = engines.NoAiEngine().analyze(chunks).first()
    assert (row["automated_writing_risk"], row["ai_likeness_score"], engines.NoSourceIndexer().index("x")) == ("low", 0.0, 0)
    made = AnalysisPipeline(both, engines.NoAiEngine()).run(docs(spark, TEXT))
    assert reports.summaries(made).first()["plagiarism_match_count"] == 1
    assert isinstance(engines.plagiarism_engine(spark, Settings(backend="local")), engines.LocalPlagiarismEngine)


def test_failing_engines_are_analysis_errors(spark):
    class Bad:
        def analyze(self, chunks, corpus_id=None):
            raise ValueError("no")

    with pytest.raises(AnalysisError, match="no"):
        AnalysisPipeline(Bad(), None).run(docs(spark, TEXT))


def test_settings():
    got = Settings.from_env({"GLEANER_CHUNK_SIZE": "9", "GLEANER_FETCH_FULL_TEXT": "false", "GLEANER_SUPPORTED_EXTENSIONS": ".txt, .md", "GLEANER_CONTACT_EMAIL": "a@b.c"}, backend="local")
    assert (got.chunk_size, got.fetch_full_text, got.supported_extensions, got.contact_email, got.backend) == (9, False, (".txt", ".md"), "a@b.c", "local")
    for bad in ({"GLEANER_BACKEND": "x"}, {"GLEANER_CHUNK_SIZE": "x"}, {"GLEANER_ENABLE_ARXIV": "maybe"}, {"GLEANER_RISK_HIGH": "0.1"}):
        with pytest.raises(ConfigurationError):
            Settings.from_env(bad)
    assert issubclass(ConfigurationError, GleanerError)


@pytest.fixture
def command(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda: spark)
    monkeypatch.setenv("GLEANER_BACKEND", "local")
    monkeypatch.setenv("GLEANER_INDEX_FILE", str(tmp_path / "index"))
    monkeypatch.setattr(cli, "setup_logging", lambda level: None)

    def run(*args):
        code = cli.main([str(a) for a in args])
        return code, *capsys.readouterr()

    return run


def test_command_line(command, tmp_path):
    root = tmp_path / "corpus"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text(TEXT)
    (root / "sub" / "b.txt").write_text("Nested file.")
    code, _, err = command("index-sources", root, "--no-recursive")
    assert code == 0 and "Scanned 1 file(s) (top-level)" in err and "Indexed: 1" in err
    code, _, err = command("index-sources", root)
    assert code == 0 and "Scanned 2 file(s) (recursive)" in err and "Indexed: 1" in err and "Up-to-date: 1" in err
    assert command("index-sources", tmp_path / "nope")[0] == 1
    code, out, err = command("analyze", root / "a.txt", "--format", "json")
    assert code == 0 and json.loads(out)["summary"]["plagiarism_match_count"] == 1
    code, out, err = command("ai-check", root / "a.txt")
    assert code == 0 and not out and err.count("[stylometric_only]") == 1 and "Copied passages" not in err
    code, out, err = command("plagiarism", root / "a.txt", "--json-out", tmp_path / "new" / "r.json")
    assert code == 0 and not out and json.loads((tmp_path / "new" / "r.json").read_text())["ai_likelihood"] is None
    assert command("analyze", root / "a.txt", "--no-plagiarism", "--no-ai-check")[0] == 0
    for bad in ("missing.txt", "corpus", "x.csv"):
        (tmp_path / "x.csv").write_text("a")
        code, _, err = command("analyze", tmp_path / bad)
        assert code == 1 and "Error:" in err
    with pytest.raises(SystemExit):
        command("analyze", root / "a.txt", "--format", "xml")


def test_documents_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"no pdf")
    with pytest.raises(IngestionError, match="pymupdf|PDF"):
        documents.read_document(spark, str(tmp_path / "a.pdf"))


def test_log_levels():
    before = logging.getLogger().handlers[:], logging.getLogger().level
    setup_logging("nonsense")
    assert logging.getLogger().level == logging.INFO
    setup_logging("debug")
    assert logging.getLogger().level == logging.DEBUG
    logging.getLogger().handlers[:], _ = before
    logging.getLogger().setLevel(before[1])


def test_threshold_zero_compares_all_chunks(spark):
    a, b = chunk.paragraphs(docs(spark, TEXT)), sources(spark, "nothing in common", TEXT)
    assert matching.pairs(a, b, replace(Settings(), jaccard_threshold=0.0)).count() == 2 and matching.pairs(a, b).count() == 1


def test_stream(spark, tmp_path):
    from gleaner.streaming import matching as stream

    docs(spark, TEXT).write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema("document_id string, text string").parquet(str(tmp_path / "in"))
    run = stream.start(read, sources(spark, TEXT), str(tmp_path / "out"), str(tmp_path / "state"))
    run.processAllAvailable()
    run.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
