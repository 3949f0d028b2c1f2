"""The analysis of documents by engines, from files or a table to reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gleaner.engines import AiLikelihoodEngine, PlagiarismEngine
from gleaner.exceptions import AnalysisError, GleanerError
from gleaner.operators.chunk import chunk
from gleaner.plans import reports
from gleaner.settings import Settings


class AnalysisPipeline:
    """``run`` gives a report for each document; an engine that fails is an ``AnalysisError``. The AI engine judges
    documents; the findings of their chunks are those of ``stylometry``."""

    def __init__(self, plagiarism_engine: PlagiarismEngine | None, ai_engine: AiLikelihoodEngine | None, settings: Settings = Settings()) -> None:
        self.plagiarism_engine, self.ai_engine, self.settings = plagiarism_engine, ai_engine, settings

    def run(self, documents: DataFrame, *, run_plagiarism: bool = True, run_ai_check: bool = True) -> DataFrame:
        chunks = chunk(documents, self.settings)
        plagiarism = ai = None
        try:
            if run_plagiarism and self.plagiarism_engine is not None:
                plagiarism = reports.plagiarism_sections(self.plagiarism_engine.analyze(chunks), documents)
            if run_ai_check and self.ai_engine is not None:
                ai = reports.ai_sections(chunks, documents, self.settings, of_documents=self.ai_engine.analyze(chunks))
        except GleanerError:
            raise
        except Exception as e:
            raise AnalysisError(f"Analysis failed: {e}") from e
        return reports.reports(documents, plagiarism, ai)
