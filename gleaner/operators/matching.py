"""Copied passages: query chunks against source chunks that share shingles.

Equi-join on hashed shingles, an upper bound of Jaccard from the counts, the exact Jaccard on the texts of what is left,
and only then the edit similarity (the one Python UDF, on Arrow batches). Keys travel through the candidate shuffle;
texts are joined to the survivors alone. At the usual thresholds a prefix of a chunk's shingles would be nearly all of
them, so none is taken; chunks whose sizes differ too much are dropped as they meet.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.text import collapse, round4, shingles, short_id, truncate, words
from gleaner.operators.chunk import chunk
from gleaner.settings import Settings

KEYS = ("document_id", "chunk_index", "source_id", "source_chunk_index")


def postings(chunks: DataFrame, key: str, n: int) -> DataFrame:
    """(shingle, key, chunk_index), a row for each shingle, repeats kept: the inverted index."""
    return chunks.select(F.explode(shingles(F.col("text"), n)).alias("shingle"), key, "chunk_index")


def _long_enough(chunks: DataFrame, settings: Settings) -> DataFrame:
    return chunks.where(F.size(words(F.col("text"))) >= settings.min_chunk_words)


def candidates(queries: DataFrame, sources: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Keys of chunks that share a shingle and may reach the Jaccard threshold: hashes stand for shingles, so what they
    have in common is counted as is, or as more. With a threshold of 0 or less every pair of chunks is one."""
    distinct = F.array_distinct(shingles(F.col("text"), settings.shingle_size))
    q = _long_enough(queries, settings).select("document_id", "chunk_index", distinct.alias("s"))
    s = sources.select("source_id", F.col("chunk_index").alias("source_chunk_index"), distinct.alias("s"))
    least = settings.jaccard_threshold
    if least <= 0:  # the result itself is all pairs
        return q.drop("s").crossJoin(s.drop("s"))
    hashed = F.explode(F.transform("s", lambda x: F.xxhash64(x))).alias("h")
    q, s = q.select("document_id", "chunk_index", F.size("s").alias("nq"), hashed), s.select("source_id", "source_chunk_index", F.size("s").alias("ns"), hashed)
    near = F.least("nq", "ns") / F.greatest("nq", "ns") >= least
    met = q.join(s, "h").where(near).groupBy(*KEYS).agg(F.count("*").alias("common"), F.first("nq").alias("nq"), F.first("ns").alias("ns"))
    most = F.col("common") / F.greatest(F.col("nq") + F.col("ns") - F.col("common"), F.greatest("nq", "ns"))
    return met.where(most >= least).select(*KEYS)


def pairs(queries: DataFrame, sources: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(the keys, common, jaccard, and of both sides text, q and s, and what else the sources and queries have) of chunks
    with a Jaccard of the threshold or more."""
    q = queries.withColumnRenamed("text", "q")
    s = sources.withColumnsRenamed({"text": "s", "chunk_index": "source_chunk_index"}).drop("chunk_id", "start_offset", "end_offset")
    texts = candidates(queries, sources, settings).join(q, ["document_id", "chunk_index"]).join(s, ["source_id", "source_chunk_index"])
    sets = texts.withColumns({"_a": F.array_distinct(shingles(F.col("q"), settings.shingle_size)), "_b": F.array_distinct(shingles(F.col("s"), settings.shingle_size))})
    counted = sets.withColumn("common", F.size(F.array_intersect("_a", "_b")).cast("long")).withColumn("_all", F.size("_a") + F.size("_b") - F.col("common"))
    jaccard = F.when(F.col("_all") > 0, F.col("common") / F.col("_all")).otherwise(0.0)
    return counted.withColumn("jaccard", jaccard).drop("_a", "_b", "_all").where(F.col("jaccard") >= settings.jaccard_threshold)


def indel(a: str, b: str) -> float:
    """100 times the normalised insert-and-delete similarity, by bit-parallel longest common subsequence."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    common = len(a) - row.bit_count()
    return 200.0 * common / (len(a) + len(b))


def similarity(a: str, b: str, least: float) -> float:
    """The similarity of the sorted words of two texts, or -1 where it is under ``least`` by the characters that both
    have, which costs a pass over each instead of one over each of their pairs."""
    x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    if x == y:
        return 100.0
    if 200.0 * (Counter(x) & Counter(y)).total() / (len(x) + len(y)) < least:
        return -1.0
    return indel(x, y)


def token_sort_ratio(a: Column | str, b: Column | str, least: float = 0.0) -> Column:
    """``similarity`` of two columns; a bound by the lengths alone is tested before a row goes to Python."""

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(x, y, least) for x, y in zip(a, b, strict=True)], dtype=float)

    return ratio(a, b)


def lengths_allow(a: Column, b: Column, least: float) -> Column:
    x, y = F.length(collapse(a)), F.length(collapse(b))
    return (x + y == 0) | (200.0 * F.least(x, y) / (x + y) >= least)


def match_type(similarity: Column) -> Column:
    return F.when(similarity >= 0.95, "exact").when(similarity >= 0.70, "near").otherwise("paraphrase")


def matches(queries: DataFrame, sources: DataFrame, settings: Settings = Settings(), *, remote: bool = False) -> DataFrame:
    """One row per pair of chunks that pass both thresholds, unmerged. ``remote`` sources are classified by the rounded
    similarity, and their chunks under the least number of words are left out. ``sources`` may have source_label and
    source_path."""
    if remote:
        sources = _long_enough(sources, settings)
    for name in ("source_label", "source_path"):
        if name not in sources.columns:
            sources = sources.withColumn(name, F.lit(None).cast("string"))
    least = settings.fuzz_threshold
    kept = pairs(queries, sources, settings).where(lengths_allow(F.col("q"), F.col("s"), least))
    passed = kept.withColumn("score", token_sort_ratio("q", "s", least)).where(F.col("score") >= least).withColumn("raw", F.col("score") / 100)
    rounded = round4(F.col("raw"))
    finding = short_id(F.lit("plag"), F.col("source_id"), F.col("source_chunk_index"), F.col("chunk_index"), separator="::")
    return passed.select(
        "document_id", F.concat(F.lit("fdg_"), finding).alias("finding_id"), "source_id", "source_label", "source_path", "source_chunk_index", "chunk_index",
        rounded.alias("similarity_score"), match_type(rounded if remote else F.col("raw")).alias("match_type"),
        F.substring("q", 1, settings.excerpt_chars).alias("matched_excerpt"), F.substring("s", 1, settings.excerpt_chars).alias("source_excerpt"), "start_offset", "end_offset",
    )


def merge(found: DataFrame) -> DataFrame:
    """Of matches with one source chunk that overlap, the better one stays; the kept one's end is the new border. A
    fold over each (document, source chunk), in the order of the start."""
    others = [c for c in found.columns if c not in ("document_id", "source_id", "source_chunk_index")]
    row = F.struct("start_offset", "chunk_index", *[c for c in others if c not in ("start_offset", "chunk_index")])
    rows = found.groupBy("document_id", "source_id", "source_chunk_index").agg(F.array_sort(F.collect_list(row)).alias("m"))

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        better = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.when(x["similarity_score"] > last["similarity_score"], x).otherwise(last)))
        return F.when((F.size(done) > 0) & (x["start_offset"] < F.get(done, F.size(done) - 1)["end_offset"]), better).otherwise(F.concat(done, F.array(x)))

    folded = rows.withColumn("m", F.aggregate("m", F.slice("m", 1, 0), step))
    return folded.select("document_id", "source_id", "source_chunk_index", F.explode("m").alias("m")).select("document_id", "source_id", "source_chunk_index", *[F.col(f"m.{c}").alias(c) for c in others])


def ranked(found: DataFrame) -> DataFrame:
    """Matches with ``rank`` within their document, from 1: the best first; of equal ones by source, its chunk, and the
    document's chunk."""
    order = Window.partitionBy("document_id").orderBy(F.desc("similarity_score"), "source_id", "source_chunk_index", "chunk_index")
    return found.withColumn("rank", F.row_number().over(order))


def summary(found: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, match_count, overall_score) of every document."""
    best = found.groupBy("document_id").agg(F.count("*").alias("match_count"), F.max("similarity_score").alias("overall_score"))
    return documents.select("document_id").join(best, "document_id", "left").select(
        "document_id", F.coalesce("match_count", F.lit(0)).cast("long").alias("match_count"), round4(F.coalesce("overall_score", F.lit(0.0))).alias("overall_score")
    )


def search_queries(chunks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(document_id, chunk_index, query_rank, query): the longest chunks of each document, short ones dropped after the
    choice."""
    order = Window.partitionBy("document_id").orderBy(F.length("text").desc(), "chunk_index")
    chosen = chunks.withColumn("query_rank", F.row_number().over(order)).where(F.col("query_rank") <= settings.query_max_chunks)
    return _long_enough(chosen, settings).select("document_id", "chunk_index", "query_rank", truncate(collapse(F.col("text")), settings.query_max_chars).alias("query"))


def first_candidates(found: DataFrame) -> DataFrame:
    """Of candidates (document_id, source_id, query_rank, provider_rank, result_rank, ...) the first of each source."""
    order = Window.partitionBy("document_id", "source_id").orderBy("query_rank", "provider_rank", "result_rank")
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def remote_chunks(resolved: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Source chunks of resolved candidates (source_id, source_label, source_path, text): texts of too few words give
    none, and chunks of too few words go."""
    names = resolved.select("source_id", "source_label", "source_path")
    texts = _long_enough(resolved, settings).select(F.col("source_id").alias("document_id"), "text")
    cut = _long_enough(chunk(texts, settings), settings).withColumnRenamed("document_id", "source_id").drop("chunk_id")
    return cut.join(names, "source_id")
