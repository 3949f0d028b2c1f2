"""From documents to reports: chunks, the analyses that are asked for, one row for each document."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gleaner.operators import matching
from gleaner.operators.chunk import chunk
from gleaner.plans import reports as made
from gleaner.settings import Settings


def hybrid(queries: DataFrame, remote: DataFrame, local: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Merged matches with remote and local sources."""
    far = matching.merge(matching.matches(queries, remote, settings, remote=True))
    near = matching.merge(matching.matches(queries, local, settings))
    return matching.merge(far.unionByName(near))


def report(
    documents: DataFrame, sources: DataFrame | None, settings: Settings = Settings(), *, remote: DataFrame | None = None, run_plagiarism: bool = True, run_ai_check: bool = True
) -> DataFrame:
    """A full report for each of ``documents`` (document_id, text). ``sources``: chunks of the corpus, ``remote``: of
    resolved remote sources; without either, nothing matches."""
    chunks = chunk(documents, settings)
    plagiarism = ai = None
    if run_plagiarism:
        near = None if sources is None else matching.merge(matching.matches(chunks, sources, settings))
        far = None if remote is None else matching.merge(matching.matches(chunks, remote, settings, remote=True))
        if near is None and far is None:
            nothing = chunks.limit(0).withColumnRenamed("document_id", "source_id")
            near = matching.matches(chunks.limit(0), nothing, settings)
        found = near if far is None else far if near is None else matching.merge(far.unionByName(near))
        plagiarism = made.plagiarism_sections(found, documents)
    if run_ai_check:
        ai = made.ai_sections(chunks, documents, settings)
    return made.reports(documents, plagiarism, ai)


def analyze(documents: DataFrame, sources: DataFrame | None, settings: Settings = Settings(), **options: object) -> DataFrame:
    """(document_id, plagiarism_match_count, plagiarism_overall_score, ai_likeness_score, automated_writing_risk,
    human_review_recommended): the summaries of ``report``."""
    return made.summaries(report(documents, sources, settings, **options))
