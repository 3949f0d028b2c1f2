"""Toxicity of texts after noisy-channel restoration of obfuscated words.

1. A character language model (order ``ORDER``) is counted on the words of all labelled training rows.
2. Tokens that look obfuscated (digits or signs among or after letters, ``*`` or ``#`` between letters, a letter three
   times or more in a row, two letters doubled, letters spaced out one by one) become a lattice of what each character
   may stand for; Viterbi decoding under the language model picks the reading. All other text stays.
3. Words of the restored text and their beginnings are hashed to ``2 ** BITS`` features. For all labelled training rows
   it is counted in how many documents of either label each feature stands; the ``FEATURES`` features most tied to
   the toxic label (by the log-likelihood ratio, ``LEAST_G2`` at least) are kept.
4. Logistic regression on the presence of these features, on a bounded sample of labelled rows. The score of a text is its probability.

Bounds: the sample has at most ``SAMPLE`` rows (half of each label, by the hash of doc_id); the model is ``FEATURES``
weights and the n-grams of the words. The counts of steps 1 and 3 cover every training row and every whole text.

Defined cases: null and empty texts are scored like texts without any feature; rows without a doc_id are scored, never
trained on; a label table that repeats a document counts it once, toxic if any row says so; null labels are ignored;
without labelled rows of both kinds every score is the share of toxic rows (0 without rows); other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb

BITS, FEATURES, LEAST_G2, SAMPLE, ORDER, REJECT_AT = 20, 8192, 24.0, 8000, 4, 0.7
BROADCAST_LABELS, FLUSH = 2_000_000, 1 << 17
PREFIXES = (4, 5, 6)

#: What signs and digits may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c",
}
SEPARATORS = " .-_*'~"
#: Costs of the channel, in nats: a sign for a letter, a sign that stands for itself, a letter more than meant, a
#: separator that hides a word, one that parts words, and a star in place of any letter.
SUBSTITUTED, LITERAL, REPEATED, HIDDEN, PARTED, MASKED = 0.7, 6.0, 1.0, 0.2, 1.0, 3.0
MASKS, ALPHABET = "*#", "abcdefghijklmnopqrstuvwxyz"

_letter = np.zeros(256, dtype=bool)
_letter[65:91] = _letter[97:123] = _letter[128:] = True
_digit = np.zeros(256, dtype=bool)
_digit[48:58] = True
_sign = np.zeros(256, dtype=bool)
_sign[[ord(c) for c in LEET]] = True
_late = np.zeros(256, dtype=bool)  # signs that stand for letters also at a word's end; the others end sentences there
_late[[ord(c) for c in "@$+|"]] = True
_mask = np.zeros(256, dtype=bool)
_mask[[ord(c) for c in MASKS]] = True
_separator = np.zeros(256, dtype=bool)
_separator[[ord(c) for c in SEPARATORS[1:]]] = True
_STRIP = "\"',;:?.)]}[{<>«»…#%&*^~`=/\\"


class CharModel:
    """A character language model with recursive smoothing; words stand between blanks."""

    def __init__(self, grams: dict[str, float], order: int = ORDER) -> None:
        self.order, self.counts, self.totals = order, dict(grams), defaultdict(float)
        for g, n in grams.items():
            self.totals[g[:-1]] += n
        self.known = max(len({g for g in grams if len(g) == 1}), 1) + 64
        self.cache: dict[str, float] = {}

    @staticmethod
    def grams(words: Counter, order: int = ORDER) -> Counter:
        out: Counter = Counter()
        for w, n in words.items():
            s = f" {w} "
            for i in range(1, len(s)):
                for k in range(min(order, i + 1)):
                    out[s[i - k : i + 1]] += n
        return out

    def log_p(self, context: str, c: str) -> float:
        key = context + c
        got = self.cache.get(key)
        if got is None:
            if len(self.cache) > 1 << 17:
                self.cache.clear()
            p = 1 / self.known
            for k in range(len(context) + 1):
                before = context[len(context) - k :]
                p = (self.counts.get(before + c, 0.0) + 4 * p) / (self.totals.get(before, 0.0) + 4)
            got = self.cache[key] = math.log(p)
        return got


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each place of a lower-cased token what may stand there ('' for nothing), with costs."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        c, j = token[i], i + 1
        if c in LEET:
            out.append([*((x, SUBSTITUTED) for x in LEET[c]), (c, LITERAL)])
        elif c in MASKS and 0 < i < len(token) - 1 and token[i - 1].isalpha() and token[j].isalpha():
            out.append([("", HIDDEN), (" ", PARTED), *((x, MASKED) for x in ALPHABET)])
        elif c in SEPARATORS:
            while j < len(token) and token[j] in SEPARATORS:
                j += 1
            out.append([("", HIDDEN), (" ", PARTED)])
        else:
            while j < len(token) and token[j] == c:
                j += 1
            if j - i == 1 or not c.isalpha():
                out.append([(c * (j - i), 0.0)])
            else:
                out.append([(c, REPEATED * (j - i == 2)), (c * 2, 0.0)])
        i = j
    return out


def decode(token: str, model: CharModel) -> str:
    """The likeliest reading of a token: Viterbi over the lattice, the states being the last characters read."""
    keep = model.order - 1
    states: dict[str, tuple[float, tuple | None]] = {" ": (0.0, None)}
    for options in [*lattice(token.lower()), [(" ", 0.0)]]:
        after: dict[str, tuple[float, tuple | None]] = {}
        for state, (score, path) in states.items():
            for text, cost in options:
                s, ctx, p = score - cost, state, path
                for c in text:
                    s += model.log_p(ctx[-keep:], c)
                    ctx, p = (ctx + c)[-keep:], (p, c)
                if ctx not in after or s > after[ctx][0]:
                    after[ctx] = (s, p)
        states = after
    best = max(states.items(), key=lambda x: (x[1][0], x[0]))[1][1]
    out = []
    while best is not None:
        best, c = best
        out.append(c)
    return "".join(reversed(out)).strip()


def suspects(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of tokens that look obfuscated, and of runs of spaced-out letters, with the text of each."""
    starts, stops, owner = tb.spans(data, tb.NOT_SPACE, offsets)
    if not len(starts):
        return starts, stops, owner
    letter = _letter[data]
    mark = np.zeros(len(data) + 2, dtype=bool)
    low = tb.LOWERED[data]
    if len(data) > 2:  # a letter three times; what is not ASCII repeats by its characters of two bytes
        mark[:-4] |= letter[:-2] & (data[:-2] < 128) & (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:])
    if len(data) > 5:
        mark[:-7] |= (data[:-5] >= 192) & (data[:-5] < 224) & (data[:-5] == data[2:-3]) & (data[:-5] == data[4:-1]) & (data[1:-4] == data[3:-2]) & (data[1:-4] == data[5:])
    if len(data) > 1:
        mark[: len(data) - 1] |= _sign[data[:-1]] & letter[1:]
        mark[1 : len(data)] |= (_digit | _late)[data[1:]] & letter[:-1]
    if len(data) > 2:
        mark[1 : len(data) - 1] |= letter[:-2] & _mask[data[1:-1]] & letter[2:]
    # a mark counts where its token begins before it and ends after it
    bad = np.zeros(len(starts), dtype=bool)
    at = np.flatnonzero(mark[: len(data)])
    token = np.searchsorted(starts, at, side="right") - 1
    fits = (token >= 0) & (at + 1 < stops[np.maximum(token, 0)]) | (token >= 0) & (_digit | _late)[data[at]] & (at > starts[np.maximum(token, 0)])
    bad[token[fits]] = True
    # what is rare is counted by its places, not by running sums over all bytes
    held = lambda mask: np.bincount(np.searchsorted(starts, np.flatnonzero(mask), side="right") - 1, minlength=len(starts))
    # two letters doubled, or more
    if len(data) > 1:
        bad |= held(letter[:-1] & (data[:-1] < 128) & (low[:-1] == low[1:])) >= 2
    # letters spaced out: four tokens or more of one letter each, of one text; a character may have several bytes
    chars = stops - starts - held((data & 0xC0) == 0x80)
    single = (chars == 1) & (letter[starts] | _sign[data[starts]])
    inner = held(_separator[data])
    for i in np.flatnonzero((inner >= 3) & (chars <= 2 * inner + 3)).tolist():
        bad[i] |= np.count_nonzero(letter[starts[i] : stops[i]] & (data[starts[i] : stops[i]] < 128)) >= 4
    joined = single[:-1] & single[1:] & (owner[:-1] == owner[1:]) & (starts[1:] - stops[:-1] <= 3)
    edge = np.diff(np.concatenate([[0], joined.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = last - first >= 3
    first, last = first[long], last[long]
    for a, b in zip(first, last, strict=True):
        bad[a : b + 1] = False
    ones = np.flatnonzero(bad)
    s = np.concatenate([starts[ones], starts[first]])
    order = np.argsort(s, kind="stable")
    return s[order], np.concatenate([stops[ones], stops[last]])[order], np.concatenate([owner[ones], owner[first]])[order]


class Restorer:
    def __init__(self, model: CharModel) -> None:
        self.model, self.cache = model, {}

    def token(self, raw: bytes) -> bytes:
        got = self.cache.get(raw)
        if got is None:
            text = raw.decode("utf-8", "replace").strip(_STRIP).rstrip("!")
            got = (" " + decode(text, self.model) + " ").encode() if any(c.isalpha() for c in text) else raw
            if len(self.cache) > 1 << 16:
                self.cache.clear()
            if len(raw) < 256:
                self.cache[raw] = got
        return got

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The slices of ``textbytes.slices``, restored."""
        for first, data, offsets in tb.slices(texts):
            starts, stops, owner = suspects(data, offsets)
            if len(starts):
                parts, at, grown = [], 0, np.zeros(len(offsets), dtype=np.int64)
                for s, e, k in zip(starts.tolist(), stops.tolist(), owner.tolist(), strict=True):
                    new = np.frombuffer(self.token(data[s:e].tobytes()), dtype=np.uint8)
                    parts += [data[at:s], new]
                    grown[k + 1] += len(new) - (e - s)
                    at = e
                data, offsets = np.concatenate([*parts, data[at:]]), offsets + np.cumsum(grown)
            yield first, data, offsets


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) of every word of a slice and of the words' beginnings."""
    data = tb.LOWERED[data]
    starts, stops, owner = tb.spans(data, tb.ALNUM, offsets)
    sums = tb.prefix_hash(data)
    found, of = [tb.span_hash(sums, starts, stops)], [owner]
    for n in PREFIXES:
        long = stops - starts >= n
        found.append(tb.mixed(tb.span_hash(sums, starts[long], starts[long] + n) + np.uint64(n)))
        of.append(owner[long])
    return (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(of)


class Model:
    """Scores texts; ``weights`` has 2 ** bits places, zero but for the kept features."""

    def __init__(self, chars: CharModel, kept: np.ndarray, weights: np.ndarray, bias: float, bits: int) -> None:
        self.chars, self.kept, self.values, self.bias, self.bits = chars, kept, weights, bias, bits

    def present(self, texts: pa.Array, restorer: Restorer) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For each slice: first text, number of texts, and (feature's place among the kept, text), each pair once."""
        place = np.full(1 << self.bits, -1, dtype=np.int32)
        place[self.kept] = np.arange(len(self.kept))
        for first, data, offsets in restorer.slices(texts):
            f, of = features(data, offsets, self.bits)
            at = place[f]
            pairs = np.unique(of[at >= 0] * np.int64(1 << 32) + at[at >= 0])
            yield first, len(offsets) - 1, pairs & 0xFFFFFFFF, pairs >> 32

    def scores(self, texts: pa.Array, restorer: Restorer) -> np.ndarray:
        out = [1 / (1 + np.exp(-(self.bias + np.bincount(of, self.values[f], n)))) for _, n, f, of in self.present(texts, restorer)]
        return np.concatenate(out) if out else np.zeros(0)


def fit(rows: list[np.ndarray], y: np.ndarray, importance: np.ndarray, start: np.ndarray, bias: float, ridge: float = 1e-3, steps: int = 500) -> tuple[np.ndarray, float]:
    """Logistic regression by AdaGrad on full batches, from the given weights; the same rows give the same weights."""
    n = len(start)
    if not len(rows):
        return start, bias
    at, owner = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    share = importance / importance.sum()
    w = np.append(start, bias)
    square = np.full(n + 1, 1e-8)
    for _ in range(steps):
        z = w[n] + np.bincount(owner, w[at], len(rows))
        gap = (1 / (1 + np.exp(-z)) - y) * share
        slope = np.append(np.bincount(at, gap[owner], n), gap.sum())
        slope[:n] += ridge / max(n, 1) * w[:n]
        square += slope * slope
        w -= 0.1 * slope / np.sqrt(square)
    return w[:n], float(w[n])


def fold(doc_id: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def train(documents: DataFrame, labels: DataFrame, *, bits: int = BITS, n_features: int = FEATURES, sample_rows: int = SAMPLE, least_g2: float = LEAST_G2) -> Model:
    """The model of ``documents`` (doc_id, text) with ``labels`` (doc_id, toxic); uses every row it is given."""
    spark = documents.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    picked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows // 2) for y in (0, 1)]
    flagged = known.join(F.broadcast(picked[0].unionByName(picked[1]).select("doc_id", F.lit(True).alias("sampled"))), "doc_id", "left")
    if sum(totals.values()) <= BROADCAST_LABELS:
        flagged = F.broadcast(flagged)
    rows = documents.select("doc_id", "text").where("text is not null").join(flagged, "doc_id").select("text", "toxic", "sampled")
    sample = rows.where("sampled")

    def told(grams: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"gram": pa.array([*grams], pa.string()), "n": pa.array([float(n) for n in grams.values()], pa.float64())})

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        grams: Counter = Counter()  # of few letters each, so that they are few, however many the words
        for batch in (part for whole in batches for part in tb.bounded(whole, "text")):
            for text in batch.column("text").to_pylist():
                words.update(w.lower() for w in text.replace(",", " ").replace(".", " ").split() if w.isalpha())
                if len(words) >= FLUSH:
                    grams.update(CharModel.grams(words))
                    words.clear()
                if len(grams) >= 4 * FLUSH:
                    yield told(grams)
                    grams.clear()
        grams.update(CharModel.grams(words))
        yield told(grams)

    grams = rows.select("text").mapInArrow(count_grams, "gram string, n double").groupBy("gram").agg(F.sum("n").alias("n"))
    chars = CharModel({r["gram"]: r["n"] for r in grams.toLocalIterator()})
    shared = spark.sparkContext.broadcast(chars)

    def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, counts = Restorer(shared.value), np.zeros((2, 1 << bits), dtype=np.int64)
        for batch in (part for whole in batches for part in tb.bounded(whole, "text")):
            toxic = np.asarray(batch.column("toxic")) > 0
            for first, data, offsets in restorer.slices(batch.column("text")):
                f, of = features(data, offsets, bits)
                pairs = np.unique(of * np.int64(1 << bits) + f)
                yes = toxic[first + (pairs >> bits)]
                f = pairs & ((1 << bits) - 1)
                counts[1] += np.bincount(f[yes], minlength=1 << bits)
                counts[0] += np.bincount(f[~yes], minlength=1 << bits)
        # features that no toxic row of this part has are left out where they can't matter: their counts are added below
        f = np.flatnonzero(counts.any(axis=0)).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"f": f, "no": counts[0][f], "yes": counts[1][f]})

    n0, n1 = float(totals.get(0, 0)), float(totals.get(1, 0))
    if not n0 or not n1:
        share = n1 / max(n0 + n1, 1)
        return Model(chars, np.zeros(0, np.int64), np.zeros(0), math.log(max(share, 1e-13) / max(1 - share, 1e-13)), bits)
    seen = rows.mapInArrow(count_features, "f int, no long, yes long").groupBy("f").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    part = lambda n, of: F.when(n > 0, n * F.log(n * (n0 + n1) / (F.col("all") * of))).otherwise(0.0)
    tied = seen.withColumn("all", F.col("no") + F.col("yes")).where(F.col("yes") * n0 > F.col("no") * n1)
    best = tied.withColumn("g2", 2 * (part(F.col("yes"), n1) + part(F.col("no"), n0))).where(F.col("g2") >= least_g2)
    chosen = sorted((r["f"], r["yes"], r["no"]) for r in best.orderBy(F.desc("g2"), "f").limit(n_features).collect())
    kept, yes, no = (np.array([r[i] for r in chosen], dtype=np.int64) for i in range(3))
    empty = Model(chars, kept, np.zeros(len(kept)), 0.0, bits)
    unfit = spark.sparkContext.broadcast(empty)

    def sampled_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(unfit.value.chars)
        for batch in batches:
            out: list[list[int]] = []
            for _, n, f, of in unfit.value.present(batch.column("text"), restorer):
                cuts = np.searchsorted(of, np.arange(1, n))
                out += [x.tolist() for x in np.split(f, cuts)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(out, pa.list_(pa.int32()))], names=["toxic", "f"])

    got = sample.select("text", "toxic").mapInArrow(sampled_features, "toxic int, f array<int>").collect()  # sample_rows at most
    got.sort(key=lambda r: (r["toxic"], r["f"]))
    y = np.array([r["toxic"] > 0 for r in got], dtype=float)
    importance = np.where(y > 0, n1 / max(y.sum(), 1), n0 / max((1 - y).sum(), 1))
    # the start: what each feature says by itself, so that features that come together don't share one weight
    odds = np.log((yes + 0.5) / (n1 + 1)) - np.log((no + 0.5) / (n0 + 1))
    weights, bias = fit([np.array(r["f"], dtype=np.int64) for r in got], y, importance, odds, math.log(n1 / n0))
    return Model(chars, kept, weights, bias, bits)


def score(documents: DataFrame, model: Model, *, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``documents`` with a column ``out`` (double): the model's probability. One pass, no shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    wide = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c != out]).withColumn(out, F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value.chars)
        for batch in (part for whole in batches for part in tb.bounded(whole, text)):
            new = pa.array(shared.value.scores(batch.column(text), restorer), pa.float64())
            yield pa.RecordBatch.from_arrays([new if n == out else batch.column(n) for n in batch.schema.names], names=batch.schema.names)

    return wide.mapInArrow(run, wide.schema)


def toxicity(documents: DataFrame, labels: DataFrame, held_out_fold: int = 1, folds: int = 3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Labels of the held-out fold are not learned from."""
    docs = documents.select("doc_id", "text")
    learn = labels.select("doc_id", "toxic").where(fold(F.col("doc_id"), folds) != held_out_fold)
    scored = score(docs, train(docs, learn), out="score")
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), folds) == held_out_fold).alias("held_out"), "score", (F.col("score") >= REJECT_AT).cast("int").alias("predicted")
    )


def without_toxic(documents: DataFrame, labels: DataFrame, reject_at: float = REJECT_AT) -> DataFrame:
    """The documents that score less than ``reject_at``, with their own columns; learns from all labelled rows."""
    model = train(documents.select("doc_id", "text"), labels)
    name = "_toxicity"
    while name in documents.columns:
        name += "_"
    return score(documents, model, out=name).where(F.col(name) < reject_at).select(*[F.col(f"`{c}`") for c in documents.columns])
