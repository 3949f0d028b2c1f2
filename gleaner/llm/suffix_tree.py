"""Language-model scores by a probabilistic suffix tree over words.

States are contexts of no, one or more words; the root is the smoothed count of single words. Level by level, strings
one word longer are looked at: those that stand ``LEAST`` times or more, whose part without the last word was looked at
before, and whose part without the first is an entry of a kept context. What follows a context in such strings are its
entries, and the context is kept if the divergence of its entries from the distribution of the next shorter state,
times their counts, outweighs what they cost (half the logarithm of the training tokens each). The tree ends where the
test keeps no context any more: its depth is the corpus's, not a parameter. A kept state gives its entries their counts
and shares what is left, and ``SMOOTHING`` more, by the next shorter state. The longest kept suffix of what was read
predicts the next word. Before the first word of a text stands the end mark.

The support is an absolute count, so words, contexts and entries grow with the corpus. They are a table keyed by the
hash of their words. In a text's score each occurrence of a string of words adds a number of its own: the root's
logarithm for a word; for an entry what its state changes; for a context what it leaves to others. So a text's score is a
sum over a join with that table. Strings with a share of the training tokens of ``SHARE`` or more (at most ``1 / SHARE``
of each length) are broadcast, as is a filter of bounded size that spares most useless rows; neither changes a result.

Strings are known by 64-bit hashes: a word's hash, and for more words the rotated hash of all but the last, xor the last.

Defined cases: null texts are empty, that is, only the end mark; rows without a doc_id belong to the held-out part;
repeated rows count and are scored as often as they stand; without training rows N and V are 0, and every token has
the probability 1; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import cut, discard, partitions, release

SHARE, LEAST, ADDED, SMOOTHING = 2.0**-21, 2, 0.1, 2.0
END = np.uint64(0x452821E638D01377)
FLUSH, BUCKET, FILTER_BITS, TURN = 1 << 22, 1 << 23, 28, 23


def tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each slice: its first text, the tokens' hashes (each text's words, then the end), where texts begin."""
    for first, n, words, at in tb.word_hashes(texts, tb.NOT_SPACE):
        yield first, np.insert(words, at[1:], END), at + np.arange(n + 1)


def longer(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return ((context << np.uint64(TURN)) | (context >> np.uint64(64 - TURN))) ^ word


def context_of(string: str, word: str) -> Column:
    """The hash of a string without its last word, from both their hashes."""
    x = F.col(string).bitwiseXOR(F.col(word))
    return F.shiftrightunsigned(x, TURN).bitwiseOR(F.shiftleft(x, 64 - TURN))


def strings(h: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For two words, three, and so on: the places where such a string ends, its hash, and those of it without its last
    and without its first word."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[at[:-1]] = END
    first = np.zeros(len(h), dtype=bool)
    first[at[:-1]] = True
    places, context, shorter = np.arange(len(h)), before, h
    while len(places):
        whole = longer(context, h[places])
        yield places, whole, context, shorter[places]
        shorter = np.zeros_like(h)
        shorter[places] = whole
        following = places + 1
        following = following[following < len(h)]
        places = following[~first[following]]
        context = shorter[places - 1]


class Filter:
    """Which hashes may be in a set: all that are, and some that are not."""

    def __init__(self, table: DataFrame) -> None:
        bits = min(FILTER_BITS, max(16, math.ceil(math.log2(32 * table.count() + 1))))
        place = F.col("k").bitwiseAND((1 << bits) - 1)
        rows = table.groupBy(F.shiftright(place, 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k & 63 as int))")).alias("m")).toArrow()
        self.mask, self.words = np.int64((1 << bits) - 1), np.zeros(1 << (bits - 6), np.int64)
        self.words[rows.column("i").to_numpy()] = rows.column("m").to_numpy()

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        k = keys.view(np.int64)
        return (self.words[(k & self.mask) >> 6] >> (k & 63)) & 1 == 1


def summed(k: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(k, kind="stable")
    k, s, n = k[order], s[order], n[order]
    begins = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[begins], s[begins], np.add.reduceat(n, begins) if len(k) else n


def counted(batches: Iterator[pa.RecordBatch], seen: Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray]]], buckets: int) -> Iterator[pa.RecordBatch]:
    """How often each pair (k, s) of ``seen`` stands in these batches, summed before it leaves the task: rows of a bucket
    of ``k`` and the packed pairs and counts in it. ``s`` belongs to ``k``, and by its order takes next to no room."""
    nothing = (np.zeros(0, np.int64),) * 3
    known, held, size = nothing, [], 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        new = [(k, s, np.ones(len(k), np.int64)) for k, s in held]
        return summed(*(np.concatenate(x) for x in zip(known, *new, strict=True)))

    for batch in (part for whole in batches for part in tb.bounded(whole, "text")):
        for k, s in seen(batch.column("text")):
            held.append((k.view(np.int64), s.view(np.int64)))
            size += len(k)
            if size >= FLUSH:
                known, held, size = merged(), [], 0
                if len(known[0]) >= FLUSH:
                    yield from _packed(*known, buckets)
                    known = nothing
    yield from _packed(*merged(), buckets)


def _packed(k: np.ndarray, s: np.ndarray, n: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    bucket = (k.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(s, kind="stable")
    order = order[np.argsort(bucket[order], kind="stable")]
    used, begins = np.unique(bucket[order], return_index=True)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for p, part in zip(used.tolist(), np.split(order, begins[1:]) if len(order) else [], strict=True):
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([squeeze(np.stack([k[part], s[part], n[part]]).tobytes())], pa.binary())], names=["p", "rows"])


def _unpacked(least: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        open_up = zstandard.ZstdDecompressor().decompress
        parts = [np.frombuffer(open_up(x), np.int64).reshape(3, -1) for x in group.column("rows").to_pylist()]
        k, s, n = summed(*np.concatenate(parts, axis=1))
        on = n >= least
        return pa.table({"k": k[on], "s": s[on], "n": n[on]})

    return run


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted value in sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Tree:
    """``table``: (k, n, base, value, known) of words and strings; what tasks get of it is in ``shared``."""

    table: DataFrame
    total: int
    distinct: int
    depth: int
    shared: tuple

    @property
    def divisor(self) -> float:
        return self.total + ADDED * (self.distinct + 1)


def train(documents: DataFrame, *, share: float = SHARE, least: int = LEAST) -> Tree:
    """The tree of all texts of ``documents``."""
    spark, texts = documents.sparkSession, documents.select("text")

    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def count(seen: Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray]]], least: int) -> DataFrame:
        """A table (k, s, n) of what stands ``least`` times or more; a bucket is what about ``BUCKET`` bytes of text give."""
        buckets = 1 + size // BUCKET
        rows = texts.mapInArrow(lambda b: counted(b, seen, buckets), "p long, rows binary").repartition(partitions(spark), "p")
        made = cut(rows.groupBy("p").applyInArrow(_unpacked(least), "k long, s long, n long"))
        release(spark)
        return made

    def words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, h, _ in tokens(column):
            yield h, h

    words_table = count(words, 1)
    vocabulary = words_table.select("k", "n")
    got = vocabulary.agg(F.sum("n"), F.count("*")).first()
    total, distinct = got[0] or 0, got[1]
    root = (F.col("n") + ADDED) / F.lit(total + ADDED * (distinct + 1))
    nothing = F.lit(0.0)
    made = [words_table]
    parts = [vocabulary.select("k", "n", F.log10(root).alias("base"), nothing.alias("value"), F.lit(1).alias("known"))]
    entries = vocabulary.where(F.col("n") >= least).select("k", F.col("k").alias("w"), "n", root.alias("p"))
    contexts, looked_at, level = entries.select("k", "n"), [], 0
    while True:
        level += 1
        entry, start = Filter(entries.select("k")), Filter(contexts.select("k"))
        shared = spark.sparkContext.broadcast((entry, start))

        def seen(column: pa.Array, level=level, shared=shared) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            entry, start = shared.value
            for _, h, at in tokens(column):
                for length, (_, whole, context, shorter) in enumerate(strings(h, at), 1):
                    if length == level:
                        on = entry(shorter) & start(context)
                        yield whole[on], shorter[on]
                        break

        found = count(seen, least)
        shared.destroy()  # its files are on each executor's disk
        of = contexts.select(F.col("k").alias("c"), F.col("n").alias("of"))
        under = entries.select(F.col("k").alias("s"), "w", F.col("p").alias("under"))
        rows = cut(found.join(under, "s").select("k", "n", "w", "under", context_of("k", "w").alias("c")).join(of, "c"))
        discard(found, *looked_at)
        release(spark)
        gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("of") / F.col("under")))
        tests = rows.groupBy("c").agg(gain.alias("gain"), F.count("*").alias("m"), F.sum("n").alias("inside"), F.first("of").alias("count"))
        cost = F.col("m") * (0.5 * math.log(max(total, 2)))
        rest = F.col("count") - F.col("inside") + SMOOTHING
        kept = cut(tests.where(F.col("gain") > cost).select("c", "count", (rest / (F.col("count") + SMOOTHING)).alias("left")))
        own = F.col("n") / (F.col("count") + SMOOTHING) + F.col("left") * F.col("under")
        after = cut(rows.join(kept, "c").select("k", "w", "n", "c", own.alias("p"), F.log10(own / F.col("under") / F.col("left")).alias("value")))
        release(spark)
        looked_at, made = [rows], [*made, kept, after]
        if after.isEmpty():
            break
        parts.append(after.select("k", "n", nothing.alias("base"), "value", F.lit(0).alias("known")))
        parts.append(kept.select(F.col("c").alias("k"), F.col("count").alias("n"), nothing.alias("base"), F.log10("left").alias("value"), F.lit(0).alias("known")))
        contexts, entries = rows.select("k", "n"), after.select("k", "w", "n", "p")
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    table = cut(union.groupBy("k").agg(F.max("n").alias("n"), F.sum("base").alias("base"), F.sum("value").alias("value"), F.max("known").alias("known")))
    discard(*looked_at, *made)
    release(spark)
    top = table.where(F.col("n") >= max(2.0, share * total)).select("k", "base", "value").toArrow()
    k, base, value = (top.column(c).to_numpy() for c in ("k", "base", "value"))
    order = np.argsort(k.view(np.uint64))
    return Tree(table, total, distinct, level, (k[order].view(np.uint64), base[order], value[order], Filter(table.where("known = 0").select("k")), level))


def score(documents: DataFrame, tree: Tree) -> DataFrame:
    """``doc_id`` of each row with n_tokens, n_known, base_score and score."""
    shared = documents.sparkSession.sparkContext.broadcast(tree.shared)
    kind = dict(documents.dtypes)["doc_id"]
    schema = f"row long, k long, m long, single boolean, doc_id {kind}, n_tokens long, n_known long, base double, own double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, bases, values, maybe, depth = shared.value
        for batch in (part for whole in batches for part in tb.bounded(whole, "text", limit=1 << 21)):
            for first, h, at in tokens(batch.column("text")):
                size = np.diff(at)
                owner = np.repeat(np.arange(len(size)), size)
                place = find(keys, h)
                on = place >= 0
                base = np.zeros(len(size)) + np.bincount(owner[on], bases[place[on]], len(size))
                own = base + np.bincount(owner[on], values[place[on]], len(size))
                known = np.bincount(owner[on], minlength=len(size))
                asked = [(owner[~on], h[~on], np.ones(int((~on).sum()), bool))]
                alive = np.ones(len(h), dtype=bool)
                for length, (places, whole, _, _) in enumerate(strings(h, at), 1):
                    if length >= depth:  # at the last level nothing was kept
                        break
                    # a string of the tree without its first word is one too: where the shorter one isn't, none is looked for
                    may = np.flatnonzero(alive[places])
                    may = may[maybe(whole[may])]
                    alive = np.zeros(len(h), dtype=bool)
                    alive[places[may]] = True
                    of, whole = owner[places[may]], whole[may]
                    place = find(keys, whole)
                    on = place >= 0
                    own += np.bincount(of[on], values[place[on]], len(size))
                    asked.append((of[~on], whole[~on], np.zeros(int((~on).sum()), bool)))
                of, k, single = (np.concatenate(x) for x in zip(*asked, strict=True))
                order = np.lexsort((k, of))
                of, k, single = of[order], k[order], single[order]
                begins = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (of[1:] != of[:-1])])[: len(k)])
                m = np.diff(np.append(begins, len(k)))
                part = batch.slice(first, len(size))
                rows = np.asarray(part.column("row"))
                count = len(begins)
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": rows[of[begins]], "k": k[begins].view(np.int64), "m": m, "single": single[begins], "doc_id": pa.nulls(count, part.column("doc_id").type),
                        "n_tokens": pa.nulls(count, pa.int64()), "n_known": pa.nulls(count, pa.int64()), "base": pa.nulls(count, pa.float64()), "own": pa.nulls(count, pa.float64()),
                    }
                )
                yield pa.RecordBatch.from_pydict(  # the texts themselves: a key each, asked for no times
                    {
                        "row": rows, "k": tb.mixed(rows.view(np.uint64) + np.uint64(1)).view(np.int64), "m": np.zeros(len(rows), np.int64), "single": np.zeros(len(rows), bool),
                        "doc_id": part.column("doc_id"), "n_tokens": size, "n_known": known, "base": base, "own": own,
                    }
                )

    asked = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, schema)
    table = tree.table.select("k", F.col("base").alias("at_root"), "value", "known")
    unseen = F.log10(F.lit(ADDED / tree.divisor)) if tree.total else F.lit(0.0)
    root = F.when(F.col("single"), F.coalesce("at_root", unseen)).otherwise(0.0)
    sums = asked.join(table, "k", "left").groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.sum(F.when(F.col("single") & (F.col("known") == 1), F.col("m")).otherwise(0))).alias("n_known"),
        F.sum(F.coalesce("base", F.lit(0.0)) + F.col("m") * root).alias("base_score"),
        F.sum(F.coalesce("own", F.lit(0.0)) + F.col("m") * (root + F.coalesce("value", F.lit(0.0)))).alias("score"),
    )
    return sums.select("doc_id", "n_tokens", "n_known", "base_score", "score")


def held_out(doc_id: Column, folds: int = 10) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0)) == 0


def scores(documents: DataFrame, *, share: float = SHARE) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = documents.select("doc_id", "text")
    tree = train(docs.where(~held_out(F.col("doc_id"))), share=share)
    return score(docs, tree).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(tree.total).cast("long").alias("train_tokens"), "base_score", "score"
    )
