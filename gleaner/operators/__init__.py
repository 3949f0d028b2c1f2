"""Operators on chunks of documents."""

from gleaner.functions.text import shingles
from gleaner.operators.chunk import paragraphs, sentences, windows
from gleaner.operators.matching import matches, merge, pairs, postings, summary
from gleaner.operators.stylometry import findings, indicators, risk, signals

__all__ = ["findings", "indicators", "matches", "merge", "pairs", "paragraphs", "postings", "risk", "sentences", "shingles", "signals", "summary", "windows"]
