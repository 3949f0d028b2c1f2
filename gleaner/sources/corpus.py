"""The source corpus: tables ``sources`` and ``chunks``, refreshed by modification time, in a folder of versions or, for
exchange, in one JSON file.

A version is complete once its ``meta`` is written, which is written last; readers take the newest complete one. So a
corpus is replaced as a whole, also by what was read from it, and a writer that fails leaves the old one as it was.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from gleaner.exceptions import CorruptIndexError, IndexingError
from gleaner.functions.text import normalize, shingles
from gleaner.operators.chunk import chunk
from gleaner.settings import Settings

VERSION = "3"
SOURCES = "source_id string, source_path string, label string, modified_at timestamp, content_hash string, indexed_at timestamp"
CHUNKS = "source_id string, chunk_index int, text string, normalized_text string, shingles array<string>, start_offset int, end_offset int"
META = "version string, updated_at timestamp, source_count long, chunk_count long, chunk_strategy string, shingle_size int"


@dataclass(frozen=True)
class IndexStats:
    indexed: int = 0
    skipped: int = 0
    up_to_date: int = 0
    total_files: int = 0
    recursive: bool = True
    index_path: str = ""


def states(files: DataFrame, known: DataFrame) -> DataFrame:
    """(source_path, state) of ``files`` (source_path, modified_at): ``new``, ``stale`` (newer than what is known) or
    ``fresh``. What is known without a time is fresh."""
    old = known.select("source_path", F.col("modified_at").alias("had"), F.lit(True).alias("is_known"))
    state = F.when(F.col("is_known").isNull(), "new").when(F.col("modified_at") > F.col("had"), "stale").otherwise("fresh")
    return files.join(old, "source_path", "left").select("source_path", state.alias("state"))


def stats(documents: DataFrame, state: DataFrame, *, recursive: bool = True, index_path: str = "") -> IndexStats:
    """How many files were indexed, skipped as unreadable, or up to date; a few numbers, summed by the executors."""
    read = documents.select("source_path", F.col("text").isNotNull().alias("read"))
    n = dict(state.join(read, "source_path").select(F.when(F.col("state") == "fresh", "fresh").when(F.col("read"), "indexed").otherwise("skipped").alias("s")).groupBy("s").count().collect())
    return IndexStats(n.get("indexed", 0), n.get("skipped", 0), n.get("fresh", 0), sum(n.values()), recursive, index_path)


def indexed(documents: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(sources, chunks) of ``documents`` (document_id, source_path, modified_at, text)."""
    sources = documents.where("text is not null").select(
        F.col("document_id").alias("source_id"), "source_path", F.element_at(F.split("source_path", "/"), -1).alias("label"), "modified_at",
        F.sha2("text", 256).alias("content_hash"), F.current_timestamp().alias("indexed_at"),
    )
    chunks = chunk(documents, settings).select(
        F.col("document_id").alias("source_id"), "chunk_index", "text", normalize(F.col("text")).alias("normalized_text"),
        shingles(F.col("text"), settings.shingle_size).alias("shingles"), "start_offset", "end_offset",
    )
    return sources, chunks


def refreshed(documents: DataFrame, sources: DataFrame, chunks: DataFrame, settings: Settings = Settings(), *, purge: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, chunks, states) after new and stale documents were indexed again; entries of a file that can't be read
    any more go, entries of files that are gone stay unless ``purge``."""
    state = states(documents.select("source_path", "modified_at"), sources)
    changed = state.where("state <> 'fresh'")
    new_sources, new_chunks = indexed(documents.join(changed, "source_path", "left_semi"), settings)
    kept = sources.join(changed, "source_path", "left_anti")
    if purge:
        kept = kept.join(documents.select("source_path"), "source_path", "left_semi")
    kept = kept.select(*new_sources.columns)
    old_chunks = chunks.join(kept.select("source_id"), "source_id", "left_semi").select(*new_chunks.columns)
    return kept.unionByName(new_sources), old_chunks.unionByName(new_chunks), state


def matchable(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Source chunks with their source's label and path, as the matching takes them."""
    names = sources.select("source_id", F.col("label").alias("source_label"), "source_path")
    return chunks.select("source_id", "chunk_index", "text", "start_offset", "end_offset").join(names, "source_id")


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _versions(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """(number, complete) of a corpus folder's versions, rising; none if there is no folder."""
    files, where = _folder(spark, path)
    if not files.exists(where):
        return []
    names = [str(f.getPath().getName()) for f in files.listStatus(where)]
    numbers = sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())
    return [(n, files.exists(_folder(spark, f"{path}/v{n}/meta/_SUCCESS")[1])) for n in numbers]


def save(folder: str, sources: DataFrame, chunks: DataFrame, settings: Settings = Settings(), *, keep: int = 2) -> None:
    """Writes a corpus as the newest version of ``folder``, or as a JSON file if it is named so. Of older complete
    versions the last ``keep - 1`` stay, for those who read them."""
    spark = sources.sparkSession
    if folder.endswith(".json"):
        return export_json(folder, sources, chunks)
    known = _versions(spark, folder)
    new = f"{folder}/v{max((n for n, _ in known), default=0) + 1}"
    try:
        sources.write.parquet(f"{new}/sources")
        chunks.write.parquet(f"{new}/chunks")
        counts = (spark.read.parquet(f"{new}/sources").count(), spark.read.schema(CHUNKS).parquet(f"{new}/chunks").count())
        row = (VERSION, datetime.now(timezone.utc), *counts, settings.chunk_strategy, settings.shingle_size)
        spark.createDataFrame([row], META).coalesce(1).write.parquet(f"{new}/meta")
    except Exception as e:
        files, where = _folder(spark, new)
        files.delete(where, True)
        raise IndexingError(f"The corpus can't be written to {folder}: {e}") from e
    whole = [n for n, complete in known if complete]
    for n, complete in known:
        if not complete or n in whole[: max(0, len(whole) - keep + 1)]:
            files, where = _folder(spark, f"{folder}/v{n}")
            files.delete(where, True)


def load(spark: SparkSession, folder: str, settings: Settings | None = None) -> tuple[DataFrame, DataFrame] | None:
    """(sources, chunks) of the newest complete version, or of a JSON file; None where there is nothing. A corpus that
    can't be used, or was made with shingles of another size, is a ``CorruptIndexError``."""
    if folder.endswith(".json"):
        return import_json(spark, folder)
    whole = [n for n, complete in _versions(spark, folder) if complete]
    if not whole:
        return None
    at = f"{folder}/v{whole[-1]}"
    try:
        found = []
        for name, schema in (("sources", SOURCES), ("chunks", CHUNKS), ("meta", META)):
            table = spark.read.parquet(f"{at}/{name}")
            wanted = spark.createDataFrame([], schema).schema
            if missing := [f.name for f in wanted if (f.name, f.dataType) not in [(g.name, g.dataType) for g in table.schema]]:
                raise CorruptIndexError(f"Index has an invalid schema: {at}/{name} (missing or of another type: {', '.join(missing)})")
            found.append(table)
        meta = found[2].first()
    except AnalysisException as e:
        raise CorruptIndexError(f"Index can't be read: {at} ({e})") from e
    if settings is not None and meta["shingle_size"] != settings.shingle_size:
        raise CorruptIndexError(f"Index {folder} was made with shingles of {meta['shingle_size']} words, not {settings.shingle_size}")
    return found[0], found[1]


def _iso(t: datetime | None) -> str | None:
    return None if t is None else t.astimezone(timezone.utc).isoformat()


def export_json(path: str, sources: DataFrame, chunks: DataFrame) -> None:
    """The corpus as one JSON file with its inverted index, written beside and then renamed. For exchange: such a file is
    read and written as a whole by whoever uses it, so sources pass through the driver one by one."""
    spark = sources.sparkSession
    row = F.struct("chunk_index", "text", "normalized_text", "shingles", F.array().cast("array<string>").alias("shingle_hashes"), "start_offset", "end_offset")
    of = chunks.groupBy(F.col("source_id").alias("of")).agg(F.array_sort(F.collect_list(row)).alias("chunks"))
    whole = sources.join(of, F.col("source_id") == F.col("of"), "left").orderBy("source_path", "source_id")
    entries: dict[str, list[dict]] = {}

    def listed() -> Iterator[dict]:
        for i, s in enumerate(whole.toLocalIterator()):
            own = [c.asDict() for c in s["chunks"] or ()]
            for c in own:
                for g in c["shingles"]:
                    entries.setdefault(g, []).append({"source_idx": i, "chunk_idx": c["chunk_index"]})
            times = {k: _iso(s[k]) for k in ("modified_at", "indexed_at")}
            yield {k: s[k] for k in ("source_id", "source_path", "label", "content_hash")} | times | {"chunks": own}

    found = [*listed()]
    data = {
        "version": VERSION, "updated_at": _iso(datetime.now(timezone.utc)), "source_count": len(found), "chunk_count": sum(len(s["chunks"]) for s in found),
        "sources": found, "inverted": {"entries": entries},
    }
    files, end = _folder(spark, path)
    _, beside = _folder(spark, f"{path}.tmp")
    try:
        out = files.create(beside, True)
        out.write(bytearray(json.dumps(data, indent=2, ensure_ascii=False).encode()))
        out.close()
        files.delete(end, False)
        if not files.rename(beside, end):
            raise IndexingError(f"{beside} can't be renamed to {end}")
        files.delete(_folder(spark, f"{end.getParent()}/.{end.getName()}.crc")[1], False)  # local sums: others may edit the file
    except Exception:
        files.delete(beside, False)
        raise


def _checked(data: object, path: str) -> dict:
    def need(test: bool, said: str) -> None:
        if not test:
            raise CorruptIndexError(f"Index file has an invalid schema: {path} ({said})")

    need(isinstance(data, dict), "not an object")
    need(isinstance(data.get("sources", []), list), "sources is no list")
    for s in data.get("sources", []):
        need(isinstance(s, dict) and isinstance(s.get("source_path"), str) and isinstance(s.get("label"), str), "a source without source_path or label")
        need(isinstance(s.get("chunks", []), list), "chunks is no list")
        for c in s.get("chunks", []):
            need(isinstance(c, dict) and isinstance(c.get("chunk_index"), int) and isinstance(c.get("text"), str), "a chunk without chunk_index or text")
            need(isinstance(c.get("shingles", []), list), "shingles is no list")
    return data


def import_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(sources, chunks) of a JSON file of version 2 or 3; its inverted index isn't needed. None if there is no file."""
    files, where = _folder(spark, path)
    if not files.exists(where):
        return None
    try:
        data = json.loads(spark.read.text(path, wholetext=True).first()[0])
    except (ValueError, TypeError) as e:
        raise CorruptIndexError(f"Index file is not valid JSON: {path} ({e})") from e
    sources, chunks = [], []
    time = lambda t: None if t is None else datetime.fromisoformat(t.replace("Z", "+00:00"))
    try:
        for s in _checked(data, path).get("sources", []):
            name = s.get("source_id") or s["source_path"]
            sources.append((name, s["source_path"], s["label"], time(s.get("modified_at")), s.get("content_hash", ""), time(s.get("indexed_at"))))
            chunks += [(name, c["chunk_index"], c["text"], c.get("normalized_text", ""), c.get("shingles", []), c.get("start_offset", 0), c.get("end_offset", 0)) for c in s.get("chunks", [])]
        return spark.createDataFrame(sources, SOURCES), spark.createDataFrame(chunks, CHUNKS)
    except (AttributeError, TypeError, ValueError) as e:
        raise CorruptIndexError(f"Index file has an invalid schema: {path} ({e})") from e
