"""Removal of repeated byte strings by sorted suffixes.

Every window of ``LENGTH`` bytes is owned by the least hash of the ``GRAM``-byte strings in it (the leftmost of equal
ones), so equal windows own equal strings at the same place: the suffixes that begin there are all that must be sorted.

1. Suffixes whose leading string stands nowhere else are dropped: they begin no repeat.
2. The others carry the bytes of the windows that they own. Splitters, sampled from them, range-partition them by
   their leading bytes, some ranges for each partition. A range comes sorted and is read as a stream of buckets, which
   end only where the leading string changes; each is sorted by multikey quicksort on tokens of eight bytes, to the
   right and to the left of where the suffixes begin, and neighbours' common lengths tell which windows are equal. All
   but the first of equal windows are repeats.
3. A leading string that fills much of a range by itself could not be cut; its windows are dealt out one by one, by
   their own bytes, come sorted by these and their places, and are compared as they pass.

The sample grows with the number of ranges, which is that of partitions twice over (``MOST_RANGES`` at most: the bound
of what the driver collects); only how even the ranges are depends on it. A string that one task meets again and again
is told twice by it, so the rows of a string grow with the tasks and not with its copies.

Equal spans meet their first copy in the slice of text where they are found, and go on as one; so a frequent passage
costs a row a slice, not a row a copy. Bytes are judged on the input: all repeats are removed at once.

Defined cases: null texts are empty; documents of fewer than ``LENGTH`` bytes lose nothing; null doc_ids come last, and
rows of equal doc_id are ordered by text; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import batches_of, cut, discard, partitions

LENGTH, GRAM, BUCKET = 100, 32, 16_384
RANGES, MOST_RANGES, SAMPLES, SEEN = 2, 1 << 14, 32, 1 << 18
REACH = LENGTH - GRAM  # how far before its string a window may begin
_PLACE = np.uint64((1 << 24) - 1)


def owned(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a slice of texts: places of strings that own windows, the first and last window of each, the strings' hashes
    and the text of each."""
    empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if len(data) < LENGTH:
        return empty
    if len(data) > 1 << 23:  # one very long text: its windows in parts, as places have 24 bits
        parts = []
        for s in range(0, len(data) - LENGTH + 1, 1 << 22):
            part = data[s : s + (1 << 22) + LENGTH - 1]
            a, f, l, h, k = owned(part, np.array([0, len(part)]))
            parts.append((a + s, f + s, l + s, h, k))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    sums = tb.prefix_hash(data)
    at = np.arange(len(data) - GRAM + 1)
    hashes = tb.span_hash(sums, at, at + GRAM)
    least = (hashes & ~_PLACE) | at.astype(np.uint64)
    done, width = 1, REACH + 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    owner = (least & _PLACE).astype(np.int64)  # of the window that begins here
    text = np.searchsorted(offsets, np.arange(len(owner)), side="right") - 1
    inside = np.arange(len(owner)) + LENGTH <= offsets[text + 1]
    windows = np.flatnonzero(inside)
    if not len(windows):
        return empty
    own, of = owner[windows], text[windows]
    begins = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (of[1:] != of[:-1])]))
    ends = np.append(begins[1:], len(windows)) - 1
    return own[begins], windows[begins], windows[ends], hashes[own[begins]], of[begins]


def _ordered(documents: DataFrame) -> DataFrame:
    """(doc, doc_id, text) with a distinct whole number for each row, in the order of doc_id."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, known, distinct = docs.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n == known == distinct:
        return docs.select(F.col("doc_id").cast("long").alias("doc"), "doc_id", "text")
    place = F.monotonically_increasing_id()  # rises with the partitions, which are in order
    return cut(docs.orderBy(F.col("doc_id").asc_nulls_last(), "text").select(place.alias("doc"), "doc_id", "text"))


def _packed(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, packed): the texts compressed, for shuffles by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = pa.array([pack.compress(t.as_buffer().to_pybytes()) for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("doc_id"), packed], names=["doc", "doc_id", "packed"])

    return docs.mapInArrow(run, f"doc long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, packed binary")


def _unpacked(packed: pa.Array) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(b.as_buffer().to_pybytes()) for b in packed]


def _strings(docs: DataFrame) -> DataFrame:
    """(key, doc, pos, known) of all owning strings; of equal ones in a slice all are known to be repeated, and only one
    carries the string's own key, as long as the task hasn't told it twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(0, np.uint64), np.zeros(0, np.uint64)  # strings told so far, sorted; forgotten when they are too many
        for batch in batches:
            doc = np.asarray(batch.column("doc"))
            for first, data, offsets in tb.slices(batch.column("text")):
                pos, _, _, h, of = owned(data, offsets)
                if not len(pos):
                    continue
                different, one, back, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                told = _among(twice, different)
                known = (n > 1)[back] | told[back]
                key = tb.mixed(h ^ (pos.astype(np.uint64) << np.uint64(32)) ^ of.astype(np.uint64))
                key[one[~told]] = different[~told]
                yield pa.RecordBatch.from_pydict({"key": key.view(np.int64), "doc": doc[first + of], "pos": (pos - offsets[of]).astype(np.int32), "known": known})
                again = ~told & _among(once, different)
                twice = np.union1d(twice, different[again]) if len(twice) < SEEN else different[again]
                once = np.union1d(once, different[~told & ~again]) if len(once) < SEEN else different[~told & ~again]

    return docs.select("doc", "text").mapInArrow(run, "key long, doc long, pos int, known boolean")


def _among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), dtype=bool)
    return keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted


def matrix(rows: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of ``width`` bytes, padded with zeros, and their lengths."""
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    out = np.zeros((len(rows), width), dtype=np.uint8)
    if len(rows):
        out[np.arange(width)[None, :] < sizes[:, None]] = np.concatenate(rows)
    return out, sizes


def multikey_sort(strings: np.ndarray) -> np.ndarray:
    """The order of rows of bytes. Quicksort by one token of eight bytes after the other: rows equal so far are a group,
    and only groups of several rows go on to the next token."""
    n, width = strings.shape
    padded = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    padded[:, :width] = strings
    tokens = padded.view(">u8").astype(np.uint64)
    order, group = np.arange(n), np.zeros(n, dtype=np.int64)  # group: by place in the order
    tied = np.arange(n)
    for k in range(tokens.shape[1]):
        if len(tied) < 2:
            break
        value = tokens[order[tied], k]
        by = np.lexsort((value, group[tied]))
        order[tied] = order[tied][by]
        value, g = value[by], group[tied]
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (g[1:] != g[:-1])])
        starts = np.flatnonzero(new)
        group[tied] = tied[starts[np.cumsum(new) - 1]]
        size = np.diff(np.append(starts, len(tied)))
        tied = tied[(size > 1)[np.cumsum(new) - 1]]
    return order


def common_lengths(strings: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many leading bytes each row of the order shares with the one before it (-1 for the first)."""
    if not len(order):
        return np.zeros(0, dtype=np.int64)
    differ = strings[order[1:]] != strings[order[:-1]]
    return np.concatenate([[-1], np.where(differ.any(axis=1), differ.argmax(axis=1), strings.shape[1])])


def classes(strings: np.ndarray, order: np.ndarray, common: np.ndarray, length: int) -> np.ndarray:
    """For each row the number of its class: rows of a class share their first ``length`` bytes."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(common < length)
    return out


def _firsts(group: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether each row is the first of its group, by document and start."""
    by = np.lexsort((start, doc, group))
    out = np.zeros(len(group), dtype=bool)
    out[by] = np.concatenate([[True], group[by][1:] != group[by][:-1]])[: len(by)]
    return out


def _spans_table(doc, start, end) -> pa.Table:
    return pa.table({"doc": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int32()), "end": pa.array(end, pa.int32())})


def compare(rows: pa.Table) -> pa.Table:
    """The spans (doc, start, end) that are repeats, from one bucket of (doc, start, lead, bytes): the bytes of a run of
    windows, ``lead`` of them before the owning string."""
    doc, start, lead = (rows.column(c).to_numpy() for c in ("doc", "start", "lead"))
    whole = [np.frombuffer(b, dtype=np.uint8) for b in rows.column("bytes").to_pylist()]
    right, r_size = matrix([b[k:] for b, k in zip(whole, lead, strict=True)], LENGTH)
    left, l_size = matrix([b[:k][::-1] for b, k in zip(whole, lead, strict=True)], REACH)
    r_order, l_order = multikey_sort(right), multikey_sort(left)
    r_common, l_common = common_lengths(right, r_order), common_lengths(left, l_order)
    size = r_size + l_size
    # equal runs: only their first goes on
    same = np.stack([classes(right, r_order, r_common, LENGTH), classes(left, l_order, l_common, REACH), r_size, l_size])
    _, run = np.unique(same, axis=1, return_inverse=True)
    first = _firsts(run.ravel(), doc, start)
    found = [(doc[~first], start[~first], start[~first] + size[~first])]
    gram = classes(right, r_order, r_common, GRAM)
    several = np.bincount(gram[first], minlength=gram.max(initial=0) + 1)[gram] > 1
    rest = np.flatnonzero(first & several)
    if len(rest):
        at = start + lead  # where the owning string begins
        again = np.zeros((len(rest), REACH + 2), dtype=bool)
        for d in range(REACH + 1):  # windows that begin d bytes before the string
            has = np.flatnonzero((l_size[rest] >= d) & (r_size[rest] >= LENGTH - d))
            if len(has) < 2:
                continue
            i = rest[has]
            group = classes(right, r_order, r_common, LENGTH - d)[i] * (len(doc) + 1) + classes(left, l_order, l_common, d)[i]
            again[has, d] = ~_firsts(group, doc[i], at[i] - d)
        edge = np.diff(np.concatenate([np.zeros((len(rest), 1), np.int8), again.astype(np.int8)], axis=1), axis=1)
        row, low = np.nonzero(edge == 1)
        _, high = np.nonzero(edge == -1)  # rows in the same order, so these pair up; one past the last
        i = rest[row]
        found.append((doc[i], at[i] - (high - 1), at[i] - low + LENGTH))
    return _spans_table(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _runs(docs: DataFrame, places: DataFrame, splitters: list[bytes], frequent: set[bytes], n_deal: int) -> DataFrame:
    """(bucket, doc, start, lead, bytes) of the runs of windows of the strings at ``places``; a null bucket marks spans
    that are known to be repeats, of ``lead`` bytes."""
    marks = np.array(splitters, dtype=f"S{GRAM}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wanted = np.asarray(batch.column("doc")), batch.column("places")
            out: list[tuple] = []
            for first, data, offsets in tb.slices(pa.array(_unpacked(batch.column("packed")), pa.large_binary())):
                pos, begin, end, _, of = owned(data, offsets)
                flag = np.zeros(len(data) + 1, dtype=bool)
                for i in range(len(offsets) - 1):
                    flag[offsets[i] + wanted[first + i].values.to_numpy()] = True
                seen: dict[tuple[int, bytes], tuple[int, int, int]] = {}
                raw = data.tobytes()
                for k in np.flatnonzero(flag[pos]).tolist():
                    a, s, e = int(pos[k]), int(begin[k]), int(end[k]) + LENGTH
                    base, doc = int(offsets[of[k]]), int(ids[first + of[k]])
                    key, me = (a - s, raw[s:e]), (doc, s - base, e - s)
                    other = seen.get(key)
                    if other is None or me < other:
                        seen[key] = me
                        me = other
                    if me:
                        last = out[-1] if out else None
                        if last and last[0] is None and last[1] == me[0] and last[2] <= me[1] <= last[2] + last[3]:
                            out[-1] = (None, me[0], last[2], max(last[3], me[1] + me[2] - last[2]), b"")
                        else:
                            out.append((None, me[0], me[1], me[2], b""))
                for (lead, text), (doc, s, _) in seen.items():
                    gram = text[lead : lead + GRAM]
                    if gram in frequent:
                        for x in range(len(text) - LENGTH + 1):
                            window = text[x : x + LENGTH]
                            out.append((-1 - int.from_bytes(hashlib.blake2b(window, digest_size=6).digest()) % n_deal, doc, s + x, -1, window))
                    else:
                        out.append((gram, doc, s, lead, text))
            if out:
                bucket, doc, s, lead, text = zip(*out, strict=True)
                grams = [g for g in bucket if isinstance(g, bytes)]
                found = iter(np.searchsorted(marks, np.array(grams, dtype=f"S{GRAM}"), side="right").tolist())
                numbers = [next(found) if isinstance(g, bytes) else g for g in bucket]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(numbers, pa.int32()), "doc": pa.array(doc, pa.int64()), "start": pa.array(s, pa.int32()), "lead": pa.array(lead, pa.int32()), "bytes": pa.array(text, pa.binary())})

    joined = _packed(docs).join(places.withColumnRenamed("doc", "of"), F.col("doc") == F.col("of")).select("doc", "packed", "places")
    return joined.mapInArrow(run, "bucket int, doc long, start int, lead int, bytes binary")


def _splitters(docs: DataFrame, places: DataFrame, n_strings: int, ranges: int) -> tuple[list[bytes], set[bytes]]:
    """Leading strings that cut the suffixes into even ranges, from about ``SAMPLES`` of them for each, and those that
    fill half a range or more (and a bucket)."""
    wanted = ranges * SAMPLES
    if n_strings <= BUCKET:
        return [], set()
    some = max(1, n_strings // wanted)  # whole documents are taken, one of so many
    few = places.where(F.pmod(F.xxhash64("doc"), F.lit(some)) == 0)
    near = few.select(F.col("doc").alias("k"))
    rows = _runs(docs.join(near, F.col("doc") == F.col("k"), "left_semi"), few, [], set(), 1).where("bucket is not null")
    grams = sorted(bytes(r[0]) for r in rows.select(F.substring("bytes", 1 + F.col("lead"), F.lit(GRAM))).toLocalIterator())
    if not grams:
        return [], set()
    cuts = [grams[len(grams) * i // ranges] for i in range(1, ranges)]
    count = Counter(grams)
    least = max(len(grams) / ranges / 2, len(grams) / n_strings * BUCKET)
    return sorted(set(cuts)), {g for g in set(cuts) if count[g] >= least}


def repeats(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, doc_id, text) of all documents, and (doc, spans): the repeated byte spans of those that have any."""
    docs = _ordered(documents)
    spark = docs.sparkSession
    with batches_of(spark, 1000):
        found = _strings(docs).withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("known or n > 1")
        places = cut(found.groupBy("doc").agg(F.sort_array(F.collect_list("pos")).alias("places")))
        n_strings = places.agg(F.sum(F.size("places"))).first()[0] or 0
        ranges = min(MOST_RANGES, RANGES * partitions(spark))
        splitters, frequent = _splitters(docs, places, n_strings, ranges)
        runs = _runs(docs, places, splitters, frequent, 8 * ranges)
        # known repeats are dealt by document: they pass through the same shuffle
        dealt = runs.withColumn("deal", F.when(F.col("bucket").isNull(), F.xxhash64("doc")).otherwise(F.xxhash64("bucket")))
        leading = F.when(F.col("lead") < 0, F.col("bytes")).otherwise(F.substring("bytes", 1 + F.col("lead"), F.lit(GRAM)))
        sorted_rows = dealt.repartition(partitions(spark), "deal").sortWithinPartitions("bucket", leading, "doc", "start")
        spans = sorted_rows.select("bucket", "doc", "start", "lead", "bytes").mapInArrow(_by_bucket, "doc long, start int, end int")
        ends = cut(spans.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")))
        discard(places)
    return docs, ends


def _gram(batch: pa.RecordBatch, i: int) -> bytes:
    lead = batch.column("lead")[i].as_py()
    return batch.column("bytes")[i].as_py()[lead : lead + GRAM]


def _by_bucket(batches: Iterator[pa.RecordBatch], size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Compares the sorted rows: known repeats (a null bucket) come first and pass, then single windows (negative
    buckets), of which all but the first of equal ones are repeats, then ranges, read in buckets of about ``size`` rows
    that end where the leading string or the range changes."""
    size = size or BUCKET
    held: list[pa.RecordBatch] = []
    n, window = 0, b""

    def compared(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if parts:
            yield from compare(pa.Table.from_batches(parts)).to_batches()

    for batch in batches:
        bucket, lead = np.asarray(batch.column("bucket").fill_null(-(1 << 31))), np.asarray(batch.column("lead"))
        known = int(np.searchsorted(bucket, -(1 << 31), side="right"))
        if known:
            doc, start, long = (batch.column(c).slice(0, known).to_numpy() for c in ("doc", "start", "lead"))
            yield from _spans_table(doc, start, start + long).to_batches()
        dealt = int(np.searchsorted(bucket, 0, side="left"))
        again = []
        for i in range(known, dealt):
            here = batch.column("bytes")[i].as_py()
            if here == window:
                again.append(i)
            window = here
        if again:
            doc, start = (batch.column(c).take(pa.array(again)).to_numpy() for c in ("doc", "start"))
            yield from _spans_table(doc, start, start + LENGTH).to_batches()
        at = dealt
        while at < batch.num_rows:
            take = min(batch.num_rows - at, max(size - n, 0))
            end = at + take
            if n + take >= size:  # full: on to the next change
                last = _gram(batch, end - 1) if take else _gram(held[-1], held[-1].num_rows - 1)
                while end < batch.num_rows and _gram(batch, end) == last:
                    end += 1
            if end > at:
                held.append(batch.slice(at, end - at))
                n += end - at
            if end < batch.num_rows and n >= size:
                yield from compared(held)
                held, n = [], 0
            at = end
    yield from compared(held)


def without(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The bytes outside of the spans, how many were removed, and in how many runs. Spans are sorted by start."""
    kept, at, n = [], 0, 0
    merged: list[list[int]] = []
    for s, e in spans:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    for s, e in merged:
        kept.append(data[at:s])
        n += e - s
        at = e
    kept.append(data[at:])
    return b"".join(kept), n, len(merged)


def removed(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs, ends = repeats(documents)
    schema = docs.select("doc_id").schema
    kind = schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, spans in zip(_unpacked(batch.column("packed")), batch.column("spans").to_pylist(), strict=True):
                kept, n, runs = without(data, [(s["start"], s["end"]) for s in spans or ()])
                out.append((len(data), n, runs, hashlib.sha256(kept).hexdigest()))
            if out:
                size, n, runs, digest = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = _packed(docs).join(ends.withColumnRenamed("doc", "of"), F.col("doc") == F.col("of"), "left").select("doc_id", "packed", "spans")
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
