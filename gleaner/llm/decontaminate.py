"""Benchmark decontamination by winnowing.

A fingerprint is the least hash of the ``gram``-word runs in each window of consecutive runs; with windows of
``span - gram + 1`` runs, any ``span`` words that a document shares with a benchmark item hold a fingerprint of both
at the same place. Fingerprints of documents are joined with those of the items and every hit is extended to the
longest shared run; runs of at least ``span`` words count. An item shorter than ``span`` words, but not empty, is one
window: runs of its own length are looked up at every place of a document.

The fingerprints of the items are cut into parts of about ``part_words`` words (an item is never cut), each broadcast
alone: a bounded size. One part is looked up in a single pass over the documents, without a shuffle. With more parts,
each has a pass of its own that keeps only what it hit, as a table; the hits are then merged by document. So neither the
driver nor a task ever holds more than one part, and only the number of passes grows with the benchmark.

Defined cases: null and wordless texts have no words and are never hit; null or wordless items match nothing; repeated
documents and items each count as they are, but equal ``item_id`` once; an item without an id marks words and is not
listed; other columns of the inputs are left alone; empty inputs give empty or clean results.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import cut, own_columns, packed

SPAN, GRAM, PART_WORDS = 13, 8, 2_000_000
RUNS = "array<struct<start:long,end:long>>"


def _windows_min(h: np.ndarray, w: int, pick) -> np.ndarray:
    out = h
    done = 1
    while done < w:  # doubling: the least of 2n from the least of n
        step = min(done, w - done)
        out = pick(out[:-step], out[step:]) if step else out
        done += step
    return out


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of every ``window`` consecutive hashes (all places of equal least hashes). Fewer
    hashes than a window are one window."""
    if not len(h):
        return np.zeros(0, dtype=np.int64)
    window = min(window, len(h))
    least = _windows_min(h, window, np.minimum)
    padded = np.concatenate([np.zeros(window - 1, h.dtype), least, np.zeros(window - 1, h.dtype)])
    return np.flatnonzero(_windows_min(padded, window, np.maximum) == h)


class Fingerprints:
    """The looked-up side: the words of some benchmark items and where their fingerprints stand."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], span: int, gram: int) -> None:
        self.span, self.gram, self.ids = span, gram, [i for i, _ in items]
        self.words = [w for _, w in items]
        long: dict[int, list[tuple[int, int]]] = defaultdict(list)
        short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, w in enumerate(self.words):
            if len(w) >= span:
                h = tb.gram_hash(w, gram)
                for q in winnow(h, span - gram + 1):
                    long[int(h[q])].append((k, int(q)))
            elif len(w):
                short[len(w)][int(tb.gram_hash(w, len(w))[0])].append(k)
        self.long, self.short = dict(long), {n: dict(x) for n, x in short.items()}
        self.keys = np.sort(np.fromiter(long, dtype=np.uint64, count=len(long)))
        self.short_keys = {n: np.sort(np.fromiter(x, dtype=np.uint64, count=len(x))) for n, x in self.short.items()}


def _among(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys) or not len(h):
        return np.zeros(len(h), dtype=bool)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return keys[at] == h


def _equal_run(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements of two arrays are equal."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def runs(words: np.ndarray, prints: Fingerprints, hits: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, item) of the longest shared runs at the fingerprints that stand at ``hits``."""
    found, done = [], {}
    h = tb.gram_hash(words, prints.gram)
    for p in hits:
        for k, q in prints.long.get(int(h[p]), ()):
            item = prints.words[k]
            if done.get((k, p - q), -1) > p:  # inside a run that is known on this diagonal
                continue
            back = _equal_run(words[:p][::-1], item[:q][::-1])
            on = _equal_run(words[p:], item[q:])
            done[(k, p - q)] = p + on
            if back + on >= prints.span:
                found.append((p - back, p + on, k))
    return found


def marked(words: np.ndarray, prints: Fingerprints, maybe: np.ndarray) -> list[tuple[int, int, int]]:
    """All (start, end, item) of item windows in a document; ``maybe``: places of winnowed known fingerprints."""
    found = runs(words, prints, maybe)
    for n, keys in prints.short_keys.items():
        h = tb.gram_hash(words, n)
        for p in np.flatnonzero(_among(h, keys)):
            for k in prints.short[n][int(h[p])]:
                if np.array_equal(words[p : p + n], prints.words[k]):
                    found.append((int(p), int(p) + n, k))
    return found


def _scan(texts: pa.Array, prints: Fingerprints) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """Words and matches of each text."""
    window = prints.span - prints.gram + 1
    for _, n, hashes, at in tb.word_hashes(texts, tb.ALNUM):
        h = tb.gram_hash(hashes, prints.gram)
        known = _among(h, prints.keys)
        for i in range(n):
            a, b = int(at[i]), int(at[i + 1])
            own = hashes[a:b]
            end = max(a, b - prints.gram + 1)
            maybe = np.zeros(0, dtype=np.int64)
            if known[a:end].any():
                chosen = winnow(h[a:end], window)
                maybe = chosen[known[a:end][chosen]]
            yield b - a, marked(own, prints, maybe) if len(maybe) or prints.short else []


def _item_parts(benchmark: DataFrame, item_id: str, text: str, part_words: int) -> Iterator[list[tuple[str | None, np.ndarray]]]:
    part, size = [], 0
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("t is not null")
    for row in rows.toLocalIterator():
        for _, _, hashes, _ in tb.word_hashes(pa.array([row["t"]], pa.large_string()), tb.ALNUM):
            part.append((row["i"], hashes))
            size += len(hashes)
        if size >= part_words:
            yield part
            part, size = [], 0
    if part:
        yield part


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    span: int = SPAN,
    gram: int = GRAM,
    part_words: int = PART_WORDS,
    prefix: str = "bench_",
) -> DataFrame:
    """``documents`` with ``<prefix>words`` (long), ``<prefix>runs`` (array of start, end: hit words, end exclusive,
    merged and sorted) and ``<prefix>items`` (array of item ids, sorted). Columns of these names are replaced."""
    if not 1 <= gram <= span:
        raise ValueError("gram must be between 1 and span")
    names = {n: f"{prefix}{n}" for n in ("words", "runs", "items")}
    gone = {n.lower() for n in names.values()}
    kept = [c for c in documents.columns if c.lower() not in gone]
    empty = {names["words"]: F.lit(0).cast("long"), names["runs"]: F.array().cast(RUNS), names["items"]: F.array().cast("array<string>")}
    wide = documents.select(*[F.col(f"`{c}`") for c in kept]).withColumns(empty)
    parts = _item_parts(benchmark, item_id, item_text, part_words)
    first, second = next(parts, []), next(parts, None)
    if second is None:
        return _looked_up(wide, first, text, names, span, gram)

    rows = cut(documents.select(F.monotonically_increasing_id().alias("row"), packed(documents.select(*[F.col(f"`{c}`") for c in kept])).alias("own"), F.col(f"`{text}`").alias("text")))
    plain = {n: n for n in names}
    passes = []
    for part in chain((first, second), parts):
        of = rows.select("row", "text").withColumns({"words": F.lit(0).cast("long"), "runs": F.array().cast(RUNS), "items": F.array().cast("array<string>")})
        found = _looked_up(of, part, "text", plain, span, gram)
        passes.append(cut((found if not passes else found.where(F.size("runs") > 0)).select("row", "words", "runs", "items")))
    hits = passes[0]
    for more in passes[1:]:
        hits = hits.unionByName(more)
    by_row = hits.groupBy(F.col("row").alias("of")).agg(
        F.max("words").alias("words"), F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    joined = rows.join(by_row, F.col("row") == F.col("of"))
    return joined.select(*own_columns(rows), F.col("words").alias(names["words"]), merged(F.col("runs")).alias(names["runs"]), F.col("items").alias(names["items"]))


def merged(runs: Column) -> Column:
    """Sorted runs, those that meet or overlap made one."""

    def step(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        one = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        joins = (F.size(done) > 0) & (r["start"] <= F.get(done, F.size(done) - 1)["end"])
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(one))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(runs, F.array().cast(RUNS), step)


def _looked_up(wide: DataFrame, part: list[tuple[str | None, np.ndarray]], text: str, names: dict[str, str], span: int, gram: int) -> DataFrame:
    """``wide`` with the three columns of ``names`` filled from one part of the benchmark."""
    shared = wide.sparkSession.sparkContext.broadcast(Fingerprints(part, span, gram))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = shared.value
        for whole in batches:
            for batch in tb.bounded(whole, text):
                counts, spans, ids = [], [], []
                for n, found in _scan(batch.column(text), prints):
                    counts.append(n)
                    runs: list[dict] = []
                    for s, e in sorted((s, e) for s, e, _ in found):
                        if runs and s <= runs[-1]["end"]:
                            runs[-1]["end"] = max(e, runs[-1]["end"])
                        else:
                            runs.append({"start": s, "end": e})
                    spans.append(runs)
                    ids.append(sorted({i for k in {k for _, _, k in found} if (i := prints.ids[k]) is not None}))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                new = {names["words"]: pa.array(counts, pa.int64()), names["runs"]: pa.array(spans, kind), names["items"]: pa.array(ids, pa.list_(pa.string()))}
                columns = [new.get(f.name, batch.column(f.name)) for f in batch.schema]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return wide.mapInArrow(scan, wide.schema)


def hit_words(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])


def is_contaminated(words: Column, hit: Column) -> Column:
    """The rule of contamination: at least a twentieth of the words, and one at least, are hit."""
    return (hit > 0) & (20 * hit >= words)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = decontaminate(documents.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        F.col("bench_words").alias("n_words"),
        hit_words(F.col("bench_runs")).alias("n_hit"),
        F.size("bench_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("bench_items", ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", is_contaminated(F.col("n_words"), F.col("n_hit")))


def clean_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns, whatever these are called."""
    prefix = "bench_"
    while any(c.lower().startswith(prefix) for c in documents.columns):
        prefix += "_"
    found = decontaminate(documents, benchmark, prefix=prefix)
    clean = ~is_contaminated(F.col(f"{prefix}words"), hit_words(F.col(f"{prefix}runs")))
    return found.where(clean).select(*[F.col(f"`{c}`") for c in documents.columns])
