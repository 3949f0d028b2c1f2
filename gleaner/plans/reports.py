"""One full report for each document: matches, indicators, findings, explanations, caveats; as columns, JSON or text."""

from __future__ import annotations

import json
import os
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from gleaner import __version__
from gleaner.functions.text import two_digits
from gleaner.operators import matching, stylometry
from gleaner.settings import Settings

SCHEMA_VERSION, SHOWN = "1.0", 10
DISCLAIMER = "The score says how far the style resembles automated writing. It is not proof of who or what wrote the text."

MATCH = (
    "struct<finding_id:string,source:struct<source_id:string,source_label:string,source_path:string,chunk_index:int,modified_at:timestamp>,similarity_score:double,"
    "matched_excerpt:string,source_excerpt:string,match_type:string,offsets:struct<start:int,end:int,unit:string,basis:string,end_exclusive:boolean>>"
)
PLAGIARISM = f"struct<document_id:string,matches:array<{MATCH}>,overall_score:double,match_count:bigint>"
FINDING = (
    f"struct<finding_id:string,chunk_index:int,ai_likeness_score:double,signals:struct<{','.join(f'{n}:double' for n in stylometry.WEIGHTS)}>,"
    "signals_triggered:array<string>,explanation:string>"
)
AI = (
    f"struct<document_id:string,indicators:array<struct<signal_name:string,value:double,description:string,triggered:boolean>>,chunk_findings:array<{FINDING}>,"
    f"ai_likeness_score:double,automated_writing_risk:string,signals_triggered:array<string>,human_review_recommended:boolean,disclaimer:string,caveats:array<{stylometry.CAVEAT}>>"
)


def _match() -> Column:
    source = F.struct(
        "source_id", F.coalesce("source_label", "source_id").alias("source_label"), F.coalesce("source_path", "source_id").alias("source_path"),
        F.col("source_chunk_index").alias("chunk_index"), F.lit(None).cast("timestamp").alias("modified_at"),
    )
    offsets = F.struct(F.col("start_offset").alias("start"), F.col("end_offset").alias("end"), F.lit("character").alias("unit"), F.lit("document_text").alias("basis"), F.lit(True).alias("end_exclusive"))
    return F.struct("finding_id", source.alias("source"), "similarity_score", "matched_excerpt", "source_excerpt", "match_type", offsets.alias("offsets"))


def plagiarism_sections(found: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, plagiarism) of every document: its merged matches, best first, and their summary."""
    listed = matching.ranked(found).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("rank", _match().alias("m")))).alias("m"))
    wide = matching.summary(found, documents).join(listed.withColumnRenamed("document_id", "_of"), F.col("document_id") == F.col("_of"), "left")
    matches = F.coalesce(F.transform("m", lambda x: x["m"]).cast(f"array<{MATCH}>"), F.array().cast(f"array<{MATCH}>"))
    return wide.select("document_id", F.struct("document_id", matches.alias("matches"), "overall_score", "match_count").cast(PLAGIARISM).alias("plagiarism"))


def ai_sections(chunks: DataFrame, documents: DataFrame, settings: Settings = Settings(), *, of_documents: DataFrame | None = None) -> DataFrame:
    """(document_id, ai_likelihood) of every document, from the rows of ``stylometry.risk`` or ones like them; one without chunks has a section of id ``unknown``, without
    indicators and caveats, of low risk."""
    names = [*stylometry.WEIGHTS]
    row = F.struct(
        "finding_id", "chunk_index", "ai_likeness_score", F.struct(*names).alias("signals"),
        F.when(F.col("signals_triggered") == "", F.array().cast("array<string>")).otherwise(F.split("signals_triggered", ",")).alias("signals_triggered"), "explanation",
    )
    of_chunks = stylometry.findings(chunks, settings).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", row.alias("f")))).alias("f"))
    values = stylometry.indicator_array({n: F.col(n) for n in names}, F.col("signals_triggered"))
    judged = stylometry.risk(chunks, settings) if of_documents is None else of_documents
    of_documents = judged.select("document_id", values.alias("indicators"), "ai_likeness_score", "automated_writing_risk", "signals_triggered", "human_review_recommended", "caveats")
    known = of_documents.join(of_chunks, "document_id").withColumnRenamed("document_id", "_of")
    wide = documents.select("document_id").join(known, F.col("document_id") == F.col("_of"), "left")
    kinds = {f.name: f.dataType.simpleString() for f in known.schema}
    full = lambda name, otherwise: F.coalesce(name, otherwise.cast(kinds[name]))
    section = F.struct(
        F.coalesce("_of", F.lit("unknown")).alias("document_id"), full("indicators", F.array()).alias("indicators"),
        F.transform(full("f", F.array()), lambda x: x["f"]).alias("chunk_findings"), F.coalesce("ai_likeness_score", F.lit(0.0)).alias("ai_likeness_score"),
        F.coalesce("automated_writing_risk", F.lit("low")).alias("automated_writing_risk"), full("signals_triggered", F.array()).alias("signals_triggered"),
        F.coalesce("human_review_recommended", F.lit(False)).alias("human_review_recommended"), F.lit(DISCLAIMER).alias("disclaimer"), full("caveats", F.array()).alias("caveats"),
    )
    return wide.select("document_id", section.cast(AI).alias("ai_likelihood"))


def reports(documents: DataFrame, plagiarism: DataFrame | None, ai: DataFrame | None, *, generated_at: datetime | None = None) -> DataFrame:
    """A report for each of ``documents`` (document_id, text; source_path, filename and format where it has them) from
    the sections; one that wasn't run is null, and the summary has zeros and the risk ``none``."""
    own = lambda name, otherwise: F.col(name) if name in documents.columns else otherwise
    path = own("source_path", F.col("document_id"))
    meta = F.struct(
        path.alias("source_path"), own("filename", F.element_at(F.split(path, "/"), -1)).alias("filename"), own("format", F.lit(".txt")).alias("file_format"),
        F.length(F.coalesce("text", F.lit(""))).alias("character_count"),
    )
    out = documents.select("document_id", meta.alias("document"))
    for section in (plagiarism, ai):
        out = out if section is None else out.join(section, "document_id", "left")
    run = [name for name, section in (("plagiarism", plagiarism), ("ai_check", ai)) if section is not None]
    got = lambda section, path, otherwise: F.lit(otherwise) if section is None else F.col(path)
    summary = F.struct(
        F.array(*map(F.lit, run)).cast("array<string>").alias("analyses_run"),
        got(plagiarism, "plagiarism.match_count", 0).cast("long").alias("plagiarism_match_count"), got(plagiarism, "plagiarism.overall_score", 0.0).alias("plagiarism_overall_score"),
        got(ai, "ai_likelihood.ai_likeness_score", 0.0).alias("ai_likeness_score"), got(ai, "ai_likelihood.automated_writing_risk", "none").alias("automated_writing_risk"),
        got(ai, "ai_likelihood.human_review_recommended", False).alias("human_review_recommended"),
    )
    now = F.current_timestamp() if generated_at is None else F.lit(generated_at)
    return out.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), "document_id", F.lit(__version__).alias("version"), F.lit("complete").alias("status"), now.alias("generated_at"),
        "document", summary.alias("summary"), (F.lit(None).cast(PLAGIARISM) if plagiarism is None else F.col("plagiarism")).alias("plagiarism"),
        (F.lit(None).cast(AI) if ai is None else F.col("ai_likelihood")).alias("ai_likelihood"),
        (F.array().cast(f"array<{stylometry.CAVEAT}>") if ai is None else F.col("ai_likelihood.caveats")).alias("caveats"),
    )


def summaries(reports: DataFrame) -> DataFrame:
    """(document_id, and the summary's columns but the list of analyses)."""
    return reports.select("document_id", "summary.*").drop("analyses_run")


def as_json(reports: DataFrame) -> DataFrame:
    """(document_id, report): JSON with every key, nulls included, other than ASCII as it is."""
    return reports.select("document_id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("report"))


def _lines(*parts: Column) -> Column:
    """Lines as an array; a part is a string or an array of strings, and null where it has none."""
    return F.flatten(F.array_compact(F.array(*parts)))


def as_text(reports: DataFrame) -> DataFrame:
    """(document_id, report): a summary to read, scores with two digits, the first ``SHOWN`` matches, and every caveat
    once."""
    line = lambda pattern, *values: F.array(F.format_string(pattern, *values))
    caveat = lambda c: F.format_string("[%s] %s", c["code"], c["message"])
    analyses = F.when(F.size("summary.analyses_run") > 0, F.array_join("summary.analyses_run", ", ")).otherwise("none")
    parts = [
        line("Document: %s", F.col("document.source_path")),
        line("Status:   %s", F.col("status")),
        line("Summary:  analyses=%s plagiarism=%s ai=%s", analyses, two_digits(F.col("summary.plagiarism_overall_score")), two_digits(F.col("summary.ai_likeness_score"))),
    ]
    matches, a = F.col("plagiarism.matches"), F.col("ai_likelihood")
    one = lambda m: F.format_string("    [%s] score=%s  source=%s  chunk#%d", m["match_type"], two_digits(m["similarity_score"]), m["source"]["source_label"], m["source"]["chunk_index"])
    copied = _lines(
        F.array(F.lit("")), line("Copied passages: overall score %s", two_digits(F.col("plagiarism.overall_score"))),
        F.when(F.size(matches) > 0, line("  %d match(es):", F.size(matches))).otherwise(F.array(F.lit("  No matches found."))),
        F.transform(F.slice(matches, 1, SHOWN), one), F.when(F.size(matches) > SHOWN, line("    ... and %d more", F.size(matches) - SHOWN)),
    )
    style = _lines(
        F.array(F.lit("")), line("AI-likeness: score %s, risk %s", two_digits(a["ai_likeness_score"]), a["automated_writing_risk"]),
        F.transform(a["indicators"], lambda i: F.format_string("  %s: %s", i["signal_name"], two_digits(i["value"]))),
        F.when(F.size(a["caveats"]) > 0, F.concat(F.array(F.lit("  Caveats:")), F.transform(a["caveats"], lambda c: F.concat(F.lit("    - "), caveat(c))))),
        line("  Disclaimer: %s", a["disclaimer"]),
    )
    parts += [F.when(F.col("plagiarism").isNotNull(), copied), F.when(a.isNotNull(), style)]
    seen = F.coalesce(a["caveats"], F.array().cast(f"array<{stylometry.CAVEAT}>"))
    rest = F.filter("caveats", lambda c: ~F.exists(seen, lambda s: (s["code"] == c["code"]) & (s["message"] == c["message"])))
    parts.append(F.when(F.size(rest) > 0, F.concat(F.array(F.lit(""), F.lit("Report caveats:")), F.transform(rest, lambda c: F.concat(F.lit("  - "), caveat(c))))))
    return reports.select("document_id", F.array_join(_lines(*parts), "\n").alias("report"))


def pretty(report: str) -> str:
    """One JSON report for people: indented by two."""
    return json.dumps(json.loads(report), indent=2, ensure_ascii=False)


def write_json(report: str, path: str) -> None:
    """One JSON report as a file; its folders are made. Many reports are written by ``DataFrame.write``."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(pretty(report))


def rendered(reports: DataFrame) -> Row:
    """The first report as (json, text): for one document."""
    return as_json(reports).withColumnRenamed("report", "json").join(as_text(reports).withColumnRenamed("report", "text"), "document_id").first()
