"""From documents to reports."""

from gleaner.plans.analysis import analyze, hybrid, report
from gleaner.plans.pipeline import AnalysisPipeline

__all__ = ["AnalysisPipeline", "analyze", "hybrid", "report"]
