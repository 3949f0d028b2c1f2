"""Documents from text, Markdown and DOCX files, any number at once; PDF where a parser is installed."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.exceptions import IngestionError

TEXT, DOCX, PDF = (".txt", ".md"), (".docx",), (".pdf",)
SUPPORTED = (*TEXT, *DOCX, *PDF)
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _paragraph(p: ElementTree.Element) -> str:
    """A paragraph's runs; tabs and line breaks are characters."""
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join(marks.get(x.tag, (x.text or "") if x.tag == f"{_W}t" else "") for r in p.iter(f"{_W}r") for x in r)


def docx_text(content: bytes) -> str:
    """The body's own paragraphs, blank ones left out, with blank lines between; tables and headers are not read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise IngestionError(f"Failed to read DOCX: {e}") from e
    body = root.find(f"{_W}body")
    texts = [_paragraph(p) for p in (root if body is None else body).findall(f"{_W}p")]
    return "\n\n".join(t for t in texts if t.strip())


def pdf_text(content: bytes) -> str:
    try:
        import pymupdf
    except ImportError as e:
        raise IngestionError("pymupdf is required to read PDF files") from e
    try:
        with pymupdf.open(stream=content, filetype="pdf") as pdf:
            return "\n\n".join(page.get_text() for page in pdf)
    except Exception as e:
        raise IngestionError(f"Failed to read PDF: {e}") from e


def plain_text(content: bytes) -> str:
    try:
        return content.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
    except UnicodeDecodeError as e:
        raise IngestionError(f"Not UTF-8: {e}") from e


def read_documents(spark: SparkSession, paths: str | list[str], *, recursive: bool = True, strict: bool = False) -> DataFrame:
    """(document_id, source_path, filename, format, modified_at, text, error) of all supported files under ``paths``.

    Files that can't be read have a null text and an ``error``; with ``strict`` they fail the query. Other files are
    skipped. The id is the hash of the path, so it is the same in every run.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
    name = F.element_at(F.split("path", "/"), -1)
    form = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    known = files.select("path", "modificationTime", "content", name.alias("filename"), form.alias("format")).where(F.col("format").isin(*SUPPORTED))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, errors = [], []
            for content, kind in zip(b["content"], b["format"], strict=True):
                try:
                    texts.append((plain_text if kind in TEXT else docx_text if kind in DOCX else pdf_text)(bytes(content)))
                    errors.append(None)
                except IngestionError as e:
                    if strict:
                        raise
                    texts.append(None)
                    errors.append(str(e))
            yield b.assign(text=texts, error=errors)[["path", "filename", "format", "modificationTime", "text", "error"]]

    parsed = known.mapInPandas(parse, "path string, filename string, format string, modificationTime timestamp, text string, error string")
    return parsed.select(
        F.sha2("path", 256).alias("document_id"), F.col("path").alias("source_path"), "filename", "format", F.col("modificationTime").alias("modified_at"), "text", "error"
    )


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """One document, as ``read_documents`` gives it; what can't be read is an ``IngestionError``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where) or not files.getFileStatus(where).isFile():
        raise IngestionError(f"Path is not a file: {path}")
    name = str(where.getName())
    if not name.lower().endswith(SUPPORTED):
        raise IngestionError(f"Unsupported file format: {name} (supported: {', '.join(SUPPORTED)})")
    got = read_documents(spark, path)
    if error := got.select("error").first()[0]:
        raise IngestionError(f"{path}: {error}")
    return got
