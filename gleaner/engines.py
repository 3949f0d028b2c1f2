"""Analyses behind common protocols, so that one can stand in for another."""

from __future__ import annotations

import logging
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import matching, stylometry
from gleaner.settings import Settings
from gleaner.sources import corpus
from gleaner.sources.documents import read_documents
from gleaner.sources.providers import Provider, default_providers, resolve, search

log = logging.getLogger(__name__)


@runtime_checkable
class PlagiarismEngine(Protocol):
    def analyze(self, chunks: DataFrame, corpus_id: str | None = None) -> DataFrame:
        """Merged matches of chunks (document_id, chunk_index, text, start_offset, end_offset)."""


@runtime_checkable
class AiLikelihoodEngine(Protocol):
    def analyze(self, chunks: DataFrame) -> DataFrame:
        """A row for each document that has chunks, as ``stylometry.risk`` gives it."""


@runtime_checkable
class SourceIndexer(Protocol):
    def index(self, directory: str, *, recursive: bool = True) -> int:
        """Indexes the files under a directory; how many it indexed."""


class LocalPlagiarismEngine:
    """Against a corpus: that of the settings, or chunks that are given. ``corpus_id`` is accepted and ignored."""

    def __init__(self, spark: SparkSession, settings: Settings = Settings(), sources: DataFrame | None = None) -> None:
        self.spark, self.settings, self.sources = spark, settings, sources

    def analyze(self, chunks: DataFrame, corpus_id: str | None = None) -> DataFrame:
        sources = self.sources
        if sources is None:
            found = corpus.load(self.spark, self.settings.index_file, self.settings)
            if found is None:
                return NoPlagiarismEngine(self.settings).analyze(chunks)
            sources = corpus.matchable(*found)
        return matching.merge(matching.matches(chunks, sources, self.settings))


class RemotePlagiarismEngine:
    """Against what providers find. No providers at all (an empty list) find nothing; None means the default ones. A
    document is compared with the sources that were found for its own queries."""

    def __init__(self, settings: Settings = Settings(), providers: list[Provider] | None = None) -> None:
        self.settings, self.providers = settings, default_providers(settings) if providers is None else providers
        self.kept: list[DataFrame] = []

    def close(self) -> None:
        """Lets go of what was fetched, once the matches have been used."""
        while self.kept:
            self.kept.pop().unpersist()

    def analyze(self, chunks: DataFrame, corpus_id: str | None = None) -> DataFrame:
        # kept, so that nothing is fetched twice
        found = search(matching.search_queries(chunks, self.settings), self.providers, self.settings).persist()
        sources = resolve(found, self.providers, self.settings).persist()
        self.kept += [found, sources]
        own = found.select("document_id", "source_id").distinct()
        return matching.merge(matching.matches(chunks, sources, self.settings, remote=True).join(own, ["document_id", "source_id"], "left_semi"))


class HybridPlagiarismEngine:
    """Remote and local matches, merged."""

    def __init__(self, remote: PlagiarismEngine, local: PlagiarismEngine) -> None:
        self.remote, self.local = remote, local

    def analyze(self, chunks: DataFrame, corpus_id: str | None = None) -> DataFrame:
        return matching.merge(self.remote.analyze(chunks, corpus_id).unionByName(self.local.analyze(chunks, corpus_id)))


class StylometricAiEngine:
    def __init__(self, settings: Settings = Settings()) -> None:
        self.settings = settings

    def analyze(self, chunks: DataFrame) -> DataFrame:
        return stylometry.risk(chunks, self.settings)


class LocalSourceIndexer:
    """Refreshes the corpus of the settings from a directory; ``last_stats`` tells what it did."""

    def __init__(self, spark: SparkSession, settings: Settings = Settings()) -> None:
        self.spark, self.settings, self.last_stats = spark, settings, None

    def index(self, directory: str, *, recursive: bool = True) -> int:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(directory)
        files = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(where) or not files.getFileStatus(where).isDirectory():
            log.error("Not a directory: %s", directory)
            return 0
        documents = read_documents(self.spark, directory, recursive=recursive).where(F.col("format").isin(*self.settings.supported_extensions))
        documents = documents.persist()  # read once: files may change meanwhile
        try:
            empty = self.spark.createDataFrame([], corpus.SOURCES), self.spark.createDataFrame([], corpus.CHUNKS)
            old = corpus.load(self.spark, self.settings.index_file, self.settings) or empty
            sources, chunks, state = corpus.refreshed(documents, *old, self.settings)
            stats = corpus.stats(documents, state, recursive=recursive, index_path=self.settings.index_file)
            corpus.save(self.settings.index_file, sources, chunks, self.settings)
        finally:
            documents.unpersist()
        self.last_stats = stats
        return stats.indexed


class NoPlagiarismEngine:
    """Finds nothing."""

    def __init__(self, settings: Settings = Settings()) -> None:
        self.settings = settings

    def analyze(self, chunks: DataFrame, corpus_id: str | None = None) -> DataFrame:
        none = chunks.limit(0)
        return matching.merge(matching.matches(none, none.withColumnRenamed("document_id", "source_id"), self.settings))


class NoAiEngine:
    """Judges nothing: every document has no signal and the risk ``low``."""

    def analyze(self, chunks: DataFrame) -> DataFrame:
        kinds = stylometry.risk(chunks.limit(0)).schema
        given = {"automated_writing_risk": F.lit("low"), "human_review_recommended": F.lit(False), "short_document": F.lit(False)}
        zero = lambda f: given.get(f.name, F.array() if f.dataType.typeName() == "array" else F.lit(0.0))
        return chunks.select("document_id").distinct().select("document_id", *[zero(f).cast(f.dataType).alias(f.name) for f in kinds if f.name != "document_id"])


class NoSourceIndexer:
    """Indexes nothing."""

    def index(self, directory: str, *, recursive: bool = True) -> int:
        return 0


def plagiarism_engine(spark: SparkSession, settings: Settings = Settings()) -> PlagiarismEngine:
    """The engine of the settings' backend."""
    local, remote = LocalPlagiarismEngine(spark, settings), RemotePlagiarismEngine(settings)
    return {"local": local, "remote": remote, "hybrid": HybridPlagiarismEngine(remote, local)}[settings.backend]
