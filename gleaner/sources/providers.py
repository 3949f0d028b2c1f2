"""Where candidate sources come from: a provider finds them for queries, and gives the text of each.

Network providers ask from the executors, a partition of queries at a time; answers are parsed by the pure functions of
``web``. A request that fails is an answer of null, which has no candidates. ``TableProvider`` needs no network.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from typing import Protocol, runtime_checkable
from urllib.parse import urlencode
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner import __version__
from gleaner.exceptions import IngestionError
from gleaner.functions.text import quoted, shingles, words
from gleaner.operators import matching
from gleaner.settings import Settings
from gleaner.sources import web
from gleaner.sources.documents import pdf_text

log = logging.getLogger(__name__)
#: An address and the accepted types to the content type and the bytes.
Fetch = Callable[[str, str], tuple[str, bytes]]
JSON, ATOM = "application/json", "application/atom+xml,application/xml"
HTML = "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8"
ANY_TEXT = "text/html,application/pdf;q=0.9,text/plain;q=0.8,*/*;q=0.7"


@runtime_checkable
class Provider(Protocol):
    name: str

    def search(self, queries: DataFrame, most: int) -> DataFrame:
        """Candidates (document_id, query_rank, result_rank, provider, source_id, source_label, source_path,
        metadata_text, full_text_url) for queries (document_id, query_rank, query), ``most`` for each."""

    def resolve(self, candidates: DataFrame) -> DataFrame:
        """(source_id, source_label, source_path, text) of candidates; a null text is a candidate without one."""


def headers(accept: str, contact: str | None = None) -> dict[str, str]:
    return {"Accept": accept, "User-Agent": f"gleaner/{__version__}" + (f" ({contact})" if contact else "")}


class HttpFetch:
    """Fetches by HTTP; any callable of the same form may stand in its place."""

    def __init__(self, settings: Settings = Settings()) -> None:
        self.timeout, self.contact = settings.timeout_seconds, settings.contact_email

    def __call__(self, url: str, accept: str) -> tuple[str, bytes]:
        with urlopen(Request(url, headers=headers(accept, self.contact)), timeout=self.timeout) as got:
            return got.headers.get_content_type().lower(), got.read()


def _tried(fetch: Fetch, url: str | None, accept: str) -> tuple[str, bytes] | None:
    if not url:
        return None
    try:
        return fetch(url, accept)
    except (OSError, RuntimeError, ValueError) as e:
        log.warning("%s can't be fetched: %s", url, e)
        return None


def fetched(rows: DataFrame, fetch: Fetch, accept: str) -> DataFrame:
    """``rows`` (document_id, query_rank, url) with ``payload`` in place of the url: the answer as text, or null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [_tried(fetch, u, accept) for u in b["url"]]
            yield b.assign(payload=[None if g is None else g[1].decode("utf-8", "ignore") for g in got])[["document_id", "query_rank", "payload"]]

    return rows.select("document_id", "query_rank", "url").mapInPandas(run, "document_id string, query_rank int, payload string")


def full_texts(candidates: DataFrame, fetch: Fetch, settings: Settings = Settings()) -> DataFrame:
    """(source_id, full_text) of candidates by their full_text_url: PDF by its parser and whole; other pages as their
    text, cut to ``max_source_chars``; null where nothing comes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pdf, page = [], []
            for url in b["full_text_url"]:
                got = _tried(fetch, url, ANY_TEXT)
                is_pdf = got is not None and (got[0] == "application/pdf" or url.lower().endswith(".pdf"))
                page.append(None if got is None or is_pdf else got[1].decode("utf-8", "ignore"))
                try:
                    pdf.append(pdf_text(got[1]) if is_pdf else None)
                except IngestionError as e:
                    log.warning("%s can't be read: %s", url, e)
                    pdf.append(None)
            yield b.assign(pdf=pdf, page=page)[["source_id", "pdf", "page"]]

    got = candidates.select("source_id", "full_text_url").mapInPandas(run, "source_id string, pdf string, page string")
    return got.select("source_id", F.coalesce("pdf", web.page_text(F.col("page"), settings.max_source_chars)).alias("full_text"))


class HttpProvider:
    """A provider that is asked by address: each names its address for a query, what it answers in, and its parser."""

    name, address, accept = "", "", JSON
    always_full = False

    def __init__(self, settings: Settings = Settings(), fetch: Fetch | None = None) -> None:
        self.settings, self.fetch = settings, fetch or HttpFetch(settings)

    def parameters(self, most: int) -> dict[str, F.Column | str]:
        raise NotImplementedError

    def parsed(self, payloads: DataFrame, most: int) -> DataFrame:
        raise NotImplementedError

    def search(self, queries: DataFrame, most: int) -> DataFrame:
        fixed = {k: v for k, v in self.parameters(most).items() if isinstance(v, str)}
        parts = [F.concat(F.lit(f"{k}="), F.url_encode(v)) for k, v in self.parameters(most).items() if not isinstance(v, str)]
        url = F.concat(F.lit(f"{self.address}?"), F.concat_ws("&", *parts, *[F.lit(urlencode(fixed))] * bool(fixed)))
        return self.parsed(fetched(queries.select("document_id", "query_rank", url.alias("url")), self.fetch, self.accept), most)

    def resolve(self, candidates: DataFrame) -> DataFrame:
        own = candidates.select("source_id", "source_label", "source_path", "metadata_text", "full_text_url")
        text = F.when(F.col("metadata_text") != "", F.col("metadata_text"))
        if self.always_full or self.settings.fetch_full_text:
            whole = full_texts(own.where("full_text_url <> ''"), self.fetch, self.settings)
            own = own.join(whole, "source_id", "left")
            text = F.coalesce(F.when(F.col("full_text") != "", F.col("full_text")), text)
        return own.select("source_id", "source_label", "source_path", text.alias("text"))


class OpenAlex(HttpProvider):
    name, address = "openalex", "https://api.openalex.org/works"

    def parameters(self, most: int) -> dict[str, F.Column | str]:
        contact = self.settings.contact_email
        return {"search": F.col("query"), "per-page": str(most)} | ({"mailto": contact} if contact else {})

    def parsed(self, payloads: DataFrame, most: int) -> DataFrame:
        return web.openalex_candidates(payloads)


class Crossref(HttpProvider):
    name, address = "crossref", "https://api.crossref.org/works"

    def parameters(self, most: int) -> dict[str, F.Column | str]:
        return {"query.bibliographic": F.col("query"), "rows": str(most)}

    def parsed(self, payloads: DataFrame, most: int) -> DataFrame:
        return web.crossref_candidates(payloads)


class Arxiv(HttpProvider):
    name, address, accept = "arxiv", "https://export.arxiv.org/api/query", ATOM

    def parameters(self, most: int) -> dict[str, F.Column | str]:
        return {"search_query": F.concat(F.lit("all:"), quoted(F.col("query"))), "start": "0", "max_results": str(most)}

    def parsed(self, payloads: DataFrame, most: int) -> DataFrame:
        return web.arxiv_candidates(payloads)


class DuckDuckGo(HttpProvider):
    name, address, accept, always_full = "duckduckgo", "https://html.duckduckgo.com/html/", HTML, True

    def parameters(self, most: int) -> dict[str, F.Column | str]:
        return {"q": quoted(F.col("query"))}

    def parsed(self, payloads: DataFrame, most: int) -> DataFrame:
        return web.duckduckgo_candidates(payloads, most)


class TableProvider:
    """Finds rows of a table (source_id, text) that share runs of ``n`` words with a query, those with most first."""

    def __init__(self, name: str, table: DataFrame, n: int = 3) -> None:
        self.name, self.table, self.n = name, table, n

    def search(self, queries: DataFrame, most: int) -> DataFrame:
        grams = lambda c: F.explode(F.array_distinct(F.transform(shingles(F.col(c), self.n), lambda x: F.xxhash64(x)))).alias("g")
        rows = self.table.select(F.col("source_id").cast("string").alias("of"), grams("text"))
        met = queries.select("document_id", "query_rank", grams("query")).join(rows, "g").groupBy("document_id", "query_rank", "of").agg(F.count("*").alias("shared"))
        order = Window.partitionBy("document_id", "query_rank").orderBy(F.desc("shared"), "of")
        best = met.withColumn("result_rank", (F.row_number().over(order) - 1).cast("int")).where(F.col("result_rank") < most)
        key = F.concat(F.lit(f"{self.name}:"), F.col("of"))
        texts = self.table.select(F.col("source_id").cast("string").alias("of"), F.col("text").alias("metadata_text"))
        return best.join(texts, "of").select(
            "document_id", "query_rank", "result_rank", F.lit(self.name).alias("provider"), key.alias("source_id"), F.col("of").alias("source_label"),
            F.col("of").alias("source_path"), "metadata_text", F.lit(None).cast("string").alias("full_text_url"),
        )

    def resolve(self, candidates: DataFrame) -> DataFrame:
        return candidates.select("source_id", "source_label", "source_path", F.col("metadata_text").alias("text"))


#: Network providers in the order in which they are asked.
REGISTRY = {"openalex": OpenAlex, "crossref": Crossref, "arxiv": Arxiv, "duckduckgo": DuckDuckGo}


def default_providers(settings: Settings = Settings(), fetch: Fetch | None = None) -> list[Provider]:
    """The enabled network providers."""
    return [kind(settings, fetch) for name, kind in REGISTRY.items() if getattr(settings, f"enable_{name}")]


def search(queries: DataFrame, providers: list[Provider], settings: Settings = Settings()) -> DataFrame:
    """All candidates of all providers for ``queries`` (document_id, query_rank, query): of each document and source the
    first. No provider means no candidates."""
    asked = queries.select(F.col("document_id").cast("string").alias("document_id"), F.col("query_rank").cast("int").alias("query_rank"), "query")
    out = queries.sparkSession.createDataFrame([], web.CANDIDATE)
    for rank, provider in enumerate(providers):
        out = out.unionByName(provider.search(asked, settings.per_provider_results).withColumn("provider_rank", F.lit(rank)))
    return matching.first_candidates(out)


def resolve(candidates: DataFrame, providers: list[Provider], settings: Settings = Settings()) -> DataFrame:
    """Source chunks of the candidates, each source once; candidates of a provider that isn't given are dropped, and so
    are texts of too few words."""
    order = Window.partitionBy("source_id").orderBy("query_rank", "provider_rank", "result_rank", "document_id")
    once = candidates.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    texts = once.sparkSession.createDataFrame([], "source_id string, source_label string, source_path string, text string")
    for provider in providers:
        texts = texts.unionByName(provider.resolve(once.where(F.col("provider") == provider.name)))
    return matching.remote_chunks(texts.where(F.size(words(F.col("text"))) >= settings.min_chunk_words), settings)
