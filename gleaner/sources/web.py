"""Pages and provider payloads: pure transforms on tables, so that fetching stays apart from parsing."""

from __future__ import annotations

import html
import re
from html.entities import html5
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.text import abstract_text, collapse, result_url, truncate


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.parts.append(data.strip())


@F.pandas_udf(T.StringType())
def html_text(pages: pd.Series) -> pd.Series:
    """All text of a page, scripts and titles included, runs joined by a blank."""

    def one(page: str | None) -> str | None:
        if page is None:
            return None
        parser = _Text()
        parser.feed(page)
        return " ".join(parser.parts)

    return pages.map(one)


@F.pandas_udf(T.StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(t))


_CLOSED = re.compile("&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)")


@F.pandas_udf(T.StringType())
def unescaped_closed(texts: pd.Series) -> pd.Series:
    """Only references that end with a semicolon are decoded."""

    def one(m: re.Match) -> str:
        return html.unescape(m.group()) if m.group(1)[0] == "#" else html5.get(m.group(1), m.group())

    return texts.map(lambda t: None if t is None else _CLOSED.sub(one, t))


def without_markup(c: Column, closed: bool = False) -> Column:
    """Text without tags, references decoded: also those without a semicolon, as browsers do, unless only ``closed``."""
    return collapse((unescaped_closed if closed else unescaped)(F.regexp_replace(c, "<[^>]+>", " ")))


def page_text(c: Column, most: int) -> Column:
    """The text of a fetched page, or without tags where the parser finds none, cut to ``most`` characters."""
    found = html_text(c)
    return truncate(F.when(F.coalesce(found, F.lit("")) != "", found).otherwise(without_markup(c)), most)


WORK = (
    "struct<id:string,doi:string,display_name:string,abstract_inverted_index:map<string,array<int>>,open_access:struct<oa_url:string>,"
    "primary_location:struct<pdf_url:string,landing_page_url:string>>"
)
ITEM = "struct<DOI:string,URL:string,title:array<string>,abstract:string>"
ENTRY, LINK = (T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in names])) for names in (("id", "title", "summary", "pdf"), ("title", "href")))
#: A candidate source, in the order of what was asked, of whom, and of the answer.
CANDIDATE = (
    "document_id string, query_rank int, provider_rank int, result_rank int, provider string, source_id string, source_label string, source_path string, "
    "metadata_text string, full_text_url string"
)
_ASKED = ("document_id", "query_rank")
_ATOM = "{http://www.w3.org/2005/Atom}"


def _first(*columns: Column) -> Column:
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def _paragraphs(*columns: Column) -> Column:
    return F.concat_ws("\n\n", *[F.when(c != "", c) for c in columns])


def _candidates(rows: DataFrame, provider: str, key: Column, label: Column, path: Column, text: Column, url: Column) -> DataFrame:
    return rows.select(
        *_ASKED, "result_rank", F.lit(provider).alias("provider"), F.concat(F.lit(f"{provider}:"), key).alias("source_id"), label.alias("source_label"),
        path.alias("source_path"), text.alias("metadata_text"), url.alias("full_text_url"),
    )


def openalex_candidates(payloads: DataFrame) -> DataFrame:
    """Candidates of (document_id, query_rank, payload): the provider's JSON answers. Missing parts are nulls."""
    works = payloads.select(*_ASKED, F.posexplode(F.from_json("payload", f"struct<results:array<{WORK}>>")["results"]).alias("result_rank", "w"))
    place = F.col("w.primary_location")
    title = F.coalesce(_first(F.col("w.display_name")), F.lit("OpenAlex work"))
    path = _first(F.col("w.doi"), F.col("w.id"), place["landing_page_url"], title)
    text = _paragraphs(title, abstract_text(F.col("w.abstract_inverted_index")))
    url = _first(F.col("w.open_access.oa_url"), place["pdf_url"], place["landing_page_url"])
    return _candidates(works, "openalex", _first(F.col("w.id"), path), title, path, text, url)


def crossref_candidates(payloads: DataFrame) -> DataFrame:
    """Candidates of (document_id, query_rank, payload): the provider's JSON answers; no full text."""
    items = payloads.select(*_ASKED, F.posexplode(F.from_json("payload", f"struct<message:struct<items:array<{ITEM}>>>")["message"]["items"]).alias("result_rank", "w"))
    title = F.coalesce(_first(F.array_join("w.title", " ")), F.lit("Crossref work"))
    path = _first(F.col("w.URL"), F.when(F.col("w.DOI") != "", F.concat(F.lit("https://doi.org/"), F.col("w.DOI"))), title)
    text = _paragraphs(title, without_markup(F.coalesce("w.abstract", F.lit(""))))
    return _candidates(items, "crossref", _first(F.col("w.DOI"), path), title, path, text, F.lit(None).cast("string"))


@F.pandas_udf(ENTRY)
def atom_entries(feeds: pd.Series) -> pd.Series:
    """(id, title, summary, pdf) of each entry of an Atom feed; null for what isn't XML."""

    def one(feed: str | None) -> list[dict] | None:
        try:
            root = ElementTree.fromstring(feed or "")
        except ElementTree.ParseError:
            return None
        out = []
        for e in root.findall(f"{_ATOM}entry"):
            text = {k: e.findtext(f"{_ATOM}{k}", default="") for k in ("id", "title", "summary")}
            pdf = next((x.get("href") for x in e.findall(f"{_ATOM}link") if x.get("title") == "pdf"), None)
            out.append(text | {"pdf": pdf})
        return out

    return feeds.map(one)


def arxiv_candidates(payloads: DataFrame) -> DataFrame:
    """Candidates of (document_id, query_rank, payload): Atom feeds. A feed that can't be read has none."""
    entries = payloads.select(*_ASKED, F.posexplode(atom_entries("payload")).alias("result_rank", "w"))
    title, summary, unnamed = collapse(F.col("w.title")), collapse(F.col("w.summary")), F.lit("arXiv work")
    key = _first(F.col("w.id"), title)
    label = F.coalesce(_first(title), unnamed)
    return _candidates(entries, "arxiv", F.coalesce(key, F.lit("")), label, F.coalesce(key, unnamed), _paragraphs(title, summary), F.col("w.pdf"))


class _Links(HTMLParser):
    """Titles and targets of a result page's links, which are anchors of the class ``result__a``."""

    def __init__(self) -> None:
        super().__init__()
        self.found: list[dict[str, str]] = []
        self.open: tuple[str, list[str]] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        known = {k: v or "" for k, v in attrs}
        if tag == "a" and "result__a" in known.get("class", "").split():
            self.open = known.get("href", ""), []

    def handle_data(self, data: str) -> None:
        if self.open:
            self.open[1].append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.open:
            href, parts = self.open
            title = " ".join(" ".join(parts).split())
            if title and href:
                self.found.append({"title": title, "href": href})
            self.open = None


@F.pandas_udf(LINK)
def result_links(pages: pd.Series) -> pd.Series:
    def one(page: str | None) -> list[dict[str, str]]:
        parser = _Links()
        parser.feed(page or "")
        return parser.found

    return pages.map(one)


def duckduckgo_candidates(payloads: DataFrame, most: int = 0) -> DataFrame:
    """Candidates of (document_id, query_rank, payload): result pages. The first ``most`` links of a page count (0: all),
    those that lead nowhere among them."""
    links = result_links("payload")
    chosen = payloads.select(*_ASKED, F.posexplode(F.slice(links, 1, most) if most > 0 else links).alias("result_rank", "w"))
    target = chosen.withColumn("target", result_url(F.col("w.href"))).where("target is not null")
    title = F.col("w.title")
    return _candidates(target, "duckduckgo", F.col("target"), title, F.col("target"), title, F.col("target"))
