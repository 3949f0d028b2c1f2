import io
import random
import zipfile

import pytest

from gleaner.exceptions import IngestionError
from gleaner.operators import chunk, matching, stylometry
from gleaner.plans import analysis
from gleaner.settings import Settings
from gleaner.sources.documents import docx_text, plain_text, read_documents


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "document_id string, text string")


@pytest.mark.parametrize("strategy", ["paragraph", "sentence", "fixed"])
def test_offsets_lead_back_to_the_text(spark, strategy):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "Dr.", "U.S.", " ", "\n", "\n\n", "\t", "x.", "é", "😀", "! ", " "]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    got = chunk.chunk(docs(spark, *texts), Settings(chunk_strategy=strategy, chunk_size=5, chunk_overlap=2)).collect()
    assert got
    for r in got:
        text = texts[int(r["document_id"][1:])]
        assert text[r["start_offset"] : r["end_offset"]] == r["text"] == r["text"].strip() != ""


def test_abbreviations_do_not_end_sentences(spark):
    got = chunk.sentences(docs(spark, "Dr. Smith came. He met J. Doe in the U.S. today. (e.g. here) End.")).orderBy("chunk_index").collect()
    assert [r["text"] for r in got] == ["Dr. Smith came.", "He met J. Doe in the U.S. today.", "(e.g.", "here) End."]


def test_windows_that_lie_in_the_one_before_stay(spark):
    got = chunk.windows(docs(spark, "a  b c\td e"), 3, 2).orderBy("chunk_index").collect()
    assert [r["text"] for r in got] == ["a  b c", "b c\td", "c\td e", "d e", "e"]


def test_blank_texts_give_no_chunks(spark):
    assert chunk.chunk(docs(spark, "", " \n\t ", None)).count() == 0


def test_indel_similarity_by_brute_force():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return 200 * row[-1] / (len(a) + len(b)) if a or b else 100

    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab c") for _ in range(rng.randint(0, 15))) for _ in "ab")
        assert matching.indel(a, b) == pytest.approx(slow(a, b))


def test_a_copied_sentence_is_found(spark):
    text = "the quick brown fox jumps over the lazy dog near the old river bank"
    queries = chunk.sentences(docs(spark, f"Nothing here at all. {text}.", "some other words that no source holds in any of its parts"))
    sources = chunk.sentences(docs(spark, f"{text}.")).withColumnRenamed("document_id", "source_id")
    got = matching.matches(queries, sources).collect()
    assert [(r["document_id"], r["match_type"], r["similarity_score"]) for r in got] == [("d0", "exact", 1.0)]


def test_merge_keeps_the_better_of_overlapping_matches(spark):
    rows = [("d", "s", 0, 0, 0, 100, 0.8), ("d", "s", 0, 1, 50, 150, 0.9), ("d", "s", 0, 2, 140, 200, 0.7), ("d", "s", 1, 3, 0, 10, 0.5), ("d", "s", 0, 4, 150, 160, 0.6)]
    found = spark.createDataFrame(rows, "document_id string, source_id string, source_chunk_index int, chunk_index int, start_offset int, end_offset int, similarity_score double")
    got = sorted((r["source_chunk_index"], r["chunk_index"]) for r in matching.merge(found).collect())
    assert got == [(0, 1), (0, 4), (1, 3)]


def test_signals_of_uniform_and_empty_texts(spark):
    chunks = docs(spark, "We go on. We go on. We go on.", "").selectExpr("document_id", "0 as chunk_index", "text")
    got = {r["document_id"]: r for r in stylometry.signals(chunks).collect()}
    assert got["d0"]["sentence_length_uniformity"] == 1.0 and got["d0"]["sentence_start_repetition"] == pytest.approx(2 / 3)
    assert got["d1"]["lexical_diversity"] == 0.0


def test_ties_of_a_chunk_round_as_in_the_sql(spark):
    text = " ".join("w " * (n - 1) + "w." for n in (55, 52, 50, 30, 25, 10, 19, 28, 51))
    got = stylometry.findings(spark.createDataFrame([("d", 0, text)], "document_id string, chunk_index int, text string")).first()
    assert got["sentence_length_uniformity"] == 0.5312  # 0.53125 exactly


@pytest.mark.parametrize("order", [1, -1])
def test_ties_of_a_document_do_not_depend_on_the_order_of_rows(spark, order):
    shares = [(1, 2), (1, 3), (1, 2), (2, 3)]  # of short sentences; summed from the last on they stay below 1/2
    rows = [("d", i, " ".join(["a."] * k + ["w " * 9 + "w."] * (n - k))) for i, (k, n) in enumerate(shares)]
    chunks = spark.createDataFrame(rows[::order], "document_id string, chunk_index int, text string").coalesce(1)
    got = stylometry.risk(chunks).first()
    assert got["short_sentence_ratio"] == 0.5 and "short_sentence_ratio" not in got["signals_triggered"]


def test_reports_leave_out_what_was_not_run(spark):
    got = analysis.analyze(docs(spark, "One sentence."), None, run_ai_check=False).collect()[0]
    assert (got["automated_writing_risk"], got["plagiarism_match_count"]) == ("none", 0)


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo")
    (tmp_path / "b.md").write_bytes(b"\xff")
    (tmp_path / "c.csv").write_text("x")
    got = {r["filename"]: r for r in read_documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"]["text"] == "one\ntwo" and got["b.md"]["error"] and "c.csv" not in got


def test_docx_and_bad_files():
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>a</w:t><w:tab/><w:t>c</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>in a table</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>b</w:t></w:r></w:p></w:body></w:document>')
    assert docx_text(body.getvalue()) == "a\tc\n\nb"
    for f, x in ((docx_text, b"no zip"), (plain_text, b"\xff")):
        with pytest.raises(IngestionError):
            f(x)


def test_entry_imports():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_strip_markup_query_decodes_closed_references_only(spark, tmp_path):
    from gleaner import queries
    from gleaner.sources import web

    page = spark.createDataFrame([(1, "<p>a&&amp;&amp</p>b &quot;&ampx; &#65;&#66 &nosuch;"), (2, None)], "page_id long, html string")
    page.write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r["text"] for r in queries.strip_markup(spark, str(tmp_path)).collect()}
    assert got[1] == 'a&&&amp b "&ampx; A&#66 &nosuch;'
    assert page.where("page_id = 1").select(web.without_markup(page["html"])).first()[0] == 'a&&& b "&x; AB &nosuch;'


def test_html_text_query_reads_whole_pages(spark, tmp_path):
    from gleaner.queries import html_text

    rows = [(1, f"<html><body><p>{'word ' * 6000}end</p></body></html>")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    (got,) = html_text(spark, str(tmp_path)).collect()
    assert len(got["text"]) == 30_003 and got["text"].endswith("end")
