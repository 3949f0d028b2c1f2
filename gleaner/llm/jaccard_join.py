"""N-gram Jaccard join by adaptive multi-match prefixes.

A document's set holds the hashes of its distinct word n-grams. Sets are compared under one global order: by hash, but
tokens that stand in very many prefixes come last. Of two sets with Jaccard >= t the first ``n - ceil(t n) + l`` tokens
of each share at least l. Each document takes the l (and so the length of its prefix) whose estimated cost is least:
the postings its prefix meets, and the candidates that must be verified, which need l common tokens. A pair needs the
lesser l of its two documents.

Texts of equal words are one class, known by a digest of 128 bits; classes are joined once. A first round tests each
prefix token's documents against one leader, the one with the fewest tokens before it (a token of very many documents
has several groups of them, whose leaders meet as well); documents that are connected already are never compared again, so a group of near copies costs one comparison a document, not all pairs. The second
round takes every pair of still unconnected documents that share enough prefix tokens, so no link between different
components is lost; pairs within the component that holds most of a token's documents are not even looked at. Filters
(lengths, and what can be common after the first shared token) only drop pairs that can't reach t. Pairs that are left
are compared by the words of their texts.

Tokens are hashes, but the result doesn't depend on them: a set's size is counted on words, and of its n-grams with one
hash the second, third and so on are tokens of their own. So two sets have at least as many tokens as n-grams in common,
which can add candidates and never lose one, and the comparison on words settles the rest.

The result is components: links within a component are not looked for, so there is no number of links.

Defined cases: texts without words, and null ones, are empty and linked with nothing; fewer words than n are one token;
repeated rows and equal texts are copies; rows without doc_id get the component id of their group's least doc_id, or
null; other columns are ignored, or come back as they were, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import batches_of, components, cut, discard, own_columns, packed, partitions, release

MOST_L, VERIFY_COST, LEAST_HEAVY, TOLD_FROM, HEAVY_TOKENS, BROADCAST_PAIRS = 4, 20, 128, 4, 1 << 20, 500_000
BATCH_ROWS, BATCH_PAIRS, PAIRS_A_LEADER, TEXTS_A_PART, LONG = 1000, 128, 512, 4096, 20_000
_NEXT = np.uint64(0x9E3779B97F4A7C15)


def token_sets(texts: pa.Array, n: int, bits: int = 64) -> Iterator[np.ndarray]:
    """The sorted tokens of each text, as many as it has distinct n-grams of words, whatever hashes collide. ``bits``:
    of the hashes, fewer for tests."""
    for _, data, offsets in tb.slices(texts):
        data = tb.LOWERED[data]
        starts, stops, owner = tb.spans(data, tb.NOT_SPACE, offsets)
        hashes, at = tb.span_hash(tb.prefix_hash(data), starts, stops), np.searchsorted(owner, np.arange(len(offsets)))
        grams = tb.gram_hash(hashes, n)
        for i in range(len(offsets) - 1):
            a, b = int(at[i]), int(at[i + 1])
            size = min(n, b - a)
            h = grams[a : b - n + 1] if b - a >= n else tb.gram_hash(hashes[a:b], b - a) if size else hashes[:0]
            h = h if bits == 64 else h & np.uint64((1 << bits) - 1)
            order = np.argsort(h, kind="stable")
            h = h[order]
            new = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
            if not new.all():
                words = lambda p: b" ".join(data[starts[q] : stops[q]].tobytes() for q in range(p, p + size))
                h = np.sort(_numbered(h, new, a + order, words, bits))
            yield h


def _numbered(h: np.ndarray, new: np.ndarray, places: np.ndarray, words, bits: int) -> np.ndarray:
    """Tokens of sorted hashes of which some are equal: one for each different n-gram."""
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(h)))
    more = []
    for i in np.flatnonzero(size > 1):
        different = len({words(int(p)) for p in places[first[i] : first[i] + size[i]]})
        for k in range(1, different):
            token = int(h[first[i]]) + (k << bits) if bits < 64 else int(h[first[i]]) + k * int(_NEXT)
            more.append(token & 0xFFFFFFFFFFFFFFFF)
    return np.concatenate([h[first], np.array(more, dtype=np.uint64)])


def common_grams(a: list[bytes], b: list[bytes], n: int) -> tuple[int, int, int]:
    """How many distinct n-grams two word lists have, and have in common; fewer words than n are one n-gram."""
    if len(a) + len(b) < LONG:
        x, y = ({*zip(*(w[i:] for i in range(n)))} if len(w) >= n else {tuple(w)} if w else set() for w in (a, b))
        return len(x), len(y), len(x & y)
    if min(len(a), len(b)) < n:  # one of them is a single n-gram of another length, or none
        return min(len(a), 1) if len(a) < n else len(a), min(len(b), 1) if len(b) < n else len(b), 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in (*a, *b)], dtype=np.int64)
    code = ids
    for i in range(1, n):  # n-grams get numbers of their own, a word more each time
        _, code = np.unique(code[:-1] * len(known) + ids[i:], return_inverse=True)
    x, y = np.unique(code[: len(a) - n + 1]), np.unique(code[len(a) :])
    return len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))


def normal(text: bytes) -> bytes:
    """A text's words in ASCII lower case, parted by one blank."""
    return b" ".join(text.lower().split())


def ceil_share(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / F.lit(100.0)).cast("int")


def _texts(documents: DataFrame, n: int, node_bits: int) -> DataFrame:
    """A table of two kinds of rows. Of each text: id, doc_id, n (its n-grams), node and rest (the digest of its words),
    and words (compressed). Of each part of the rows: the tokens that ``TOLD_FROM`` of its classes hold, with how many
    (token, df). All texts are counted; what stays untold only puts a token earlier in the order."""

    def told(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        token, df = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return token[df >= TOLD_FROM].view(np.int64), df[df >= TOLD_FROM].astype(np.int64)

    def rows(kind: pa.DataType, **columns: pa.Array) -> pa.RecordBatch:
        kinds = {"id": pa.int64(), "doc_id": kind, "n": pa.int32(), "node": pa.int64(), "rest": pa.int64(), "words": pa.binary(), "token": pa.int64(), "df": pa.int64()}
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(size, k) for c, k in kinds.items()], names=[*kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen, kind = [], 0, set(), None
        for whole in batches:
            kind = whole.schema.field("doc_id").type
            for batch in tb.bounded(whole, "text"):
                pack = zstandard.ZstdCompressor(level=3)
                sizes, nodes, rests, words = [], [], [], []
                for tokens, text in zip(token_sets(batch.column("text"), n), batch.column("text"), strict=True):
                    plain = normal(text.as_buffer().to_pybytes()) if len(tokens) else b""
                    digest = np.frombuffer(hashlib.blake2b(plain, digest_size=16).digest(), dtype=np.int64)
                    sizes.append(len(tokens))
                    nodes.append(int(digest[0]) >> (64 - node_bits))
                    rests.append(int(digest[1]))
                    words.append(pack.compress(plain))
                    if len(tokens) and digest.tobytes() not in seen:
                        seen.add(digest.tobytes())
                        held.append(tokens)
                        size += len(tokens)
                own = {"n": pa.array(sizes, pa.int32()), "node": pa.array(nodes, pa.int64()), "rest": pa.array(rests, pa.int64()), "words": pa.array(words, pa.binary())}
                yield rows(kind, id=batch.column("id"), doc_id=batch.column("doc_id"), **own)
                if size >= 1 << 21:
                    token, df = told(held)
                    yield rows(kind, token=pa.array(token), df=pa.array(df))
                    held, size, seen = [], 0, set()
        if held:
            token, df = told(held)
            yield rows(kind, token=pa.array(token), df=pa.array(df))

    kind = dict(documents.dtypes)["doc_id"]
    schema = f"id long, doc_id {kind}, n int, node long, rest long, words binary, token long, df long"
    return cut(documents.select("id", "doc_id", "text").mapInArrow(run, schema))


def _classes(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts of ``table`` and (node, id, first_id) of their classes. A node is half of a digest; where different
    digests share one, which at any size is rare, their texts get new nodes by the whole digest."""
    texts = table.where("id is not null").drop("token", "df")
    texts.gleaner_path = table.gleaner_path
    while True:
        seen = cut(texts.where("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.min("doc_id").alias("first_id"), F.min("rest").alias("low"), F.max("rest").alias("high")))
        shared = seen.where("low <> high").select(F.col("node").alias("of"))
        if shared.isEmpty():
            return texts, seen.select("node", "id", "first_id")
        again = texts.join(F.broadcast(shared), F.col("node") == F.col("of"), "left")
        texts = cut(again.withColumn("node", F.when(F.col("of").isNotNull(), F.xxhash64("node", "rest")).otherwise(F.col("node"))).drop("of"))


def _prefixes(texts: DataFrame, n: int, percent: int, extra: int, heavy, bits: int) -> DataFrame:
    """(token, part, node, n, pos) of each text's prefix, ``extra`` tokens longer than the shortest; a class once a task.
    ``heavy``: the frequent tokens and into how many parts the texts of each are dealt; part 0 holds all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (last, parts), seen, unpack = heavy.value, set(), zstandard.ZstdDecompressor()
        for batch in batches:
            mine = [(node, words) for node, words in zip(batch.column("node").to_pylist(), batch.column("words"), strict=True) if node not in seen and not seen.add(node)]
            if len(seen) > 1 << 20:
                seen.clear()
            plain = pa.array([unpack.decompress(w.as_buffer().to_pybytes()) for _, w in mine], pa.large_binary())
            for (node, _), s in zip(mine, token_sets(plain.cast(pa.large_string(), safe=False), n, bits), strict=True):
                s, size = s.view(np.int64), len(s)
                most = min(size, size + (-percent * size // 100) + 1 + extra)
                part = np.zeros(len(s), np.int32)
                if len(last):
                    at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                    is_last = last[at] == s
                    several = parts[at[is_last]]
                    part[is_last] = np.where(several > 1, 1 + node % several, 0)
                    s, part = (np.concatenate([x[~is_last], x[is_last]]) for x in (s, part))
                s, part = s[:most], part[:most]
                yield pa.RecordBatch.from_pydict({"token": s, "part": part, "node": np.full(len(s), node), "n": np.full(len(s), size, np.int32), "pos": np.arange(len(s), dtype=np.int32)})

    return texts.where("n > 0").select("node", "words").mapInArrow(_joined_batches(run), "token long, part int, node long, n int, pos int")


def _joined_batches(run):
    """``run`` with its small batches put together."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in run(batches):
            held.append(b)
            size += b.num_rows
            if size >= 1 << 16:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return joined


def _similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets of n-grams have Jaccard >= percent / 100, by their words. ``a`` may stand in
    very many pairs: these are parted, and its text goes to each part."""
    first = classes.select("node", "id")
    named = cut(
        pairs.join(first.select(F.col("node").alias("a"), F.col("id").alias("ia")), "a").join(first.select(F.col("node").alias("b"), F.col("id").alias("ib")), "b")
    )
    leaders = named.groupBy("ia").agg(F.ceil(F.count("*") / PAIRS_A_LEADER).cast("int").alias("parts"))
    parted = named.join(leaders, "ia").select("a", "b", "ia", "ib", F.pmod(F.xxhash64("ib"), F.col("parts")).cast("int").alias("part"))
    small = F.broadcast if named.count() <= BROADCAST_PAIRS else (lambda df: df)
    whole = texts.select("id", "words")
    members = whole.join(small(parted), F.col("id") == F.col("ib")).select("a", "b", "ia", "part", F.col("words").alias("wb"))
    copies = whole.join(small(leaders.withColumnRenamed("ia", "of")), F.col("id") == F.col("of")).select("of", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("for"), F.col("words").alias("wa"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, last, left = zstandard.ZstdDecompressor(), None, []
        for batch in batches:
            keep = []
            for a, wa, wb in zip(batch.column("a").to_pylist(), batch.column("wa"), batch.column("wb"), strict=True):
                if a != last:
                    last, left = a, unpack.decompress(wa.as_buffer().to_pybytes()).split()
                x, y, both = common_grams(left, unpack.decompress(wb.as_buffer().to_pybytes()).split(), n)
                keep.append(100 * both >= percent * (x + y - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = members.join(copies, (F.col("ia") == F.col("of")) & (F.col("part") == F.col("for"))).select("a", "b", "wa", "wb")
    with batches_of(texts.sparkSession, BATCH_PAIRS):
        links = cut(met.mapInArrow(run, "a long, b long"))
    discard(named)
    return links


def similar_documents(documents: DataFrame, *, n: int = 3, percent: int = 90, bits: int = 64, node_bits: int = 64) -> DataFrame:
    """(id, doc_id, n_shingles, component_id) of each row of ``documents`` (id, doc_id, text; each row its own id). Rows
    with the same component_id are connected by pairs of Jaccard >= percent / 100. ``bits`` and ``node_bits``: of the
    hashes of n-grams and of classes; the result is the same with any."""
    texts, grouped = _grouped(documents, n, percent, bits, node_bits)
    least = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    names = grouped.join(least, "component").select(F.col("node").alias("of"), "component_id")
    found = texts.select("id", "doc_id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(names, F.col("node") == F.col("of"), "left")
    return found.select("id", "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _grouped(documents: DataFrame, n: int, percent: int, bits: int = 64, node_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """The table of texts, and (node, id, first_id, component) of each class; a component is its least node, whatever
    the doc_ids are."""
    with batches_of(documents.sparkSession, BATCH_ROWS):  # all that runs Python runs here, in tables
        texts, classes, ends = _joined(documents, n, percent, bits, node_bits)
    return texts, classes.join(ends, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _heavy(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, sorted, ``HEAVY_TOKENS`` at most (the bound of what is broadcast), and the parts into
    which the texts of each are dealt."""
    often = cut(table.where("id is null").groupBy("token").agg(F.sum("df").alias("df")))
    limit = LEAST_HEAVY
    while often.where(F.col("df") > limit).count() > HEAVY_TOKENS:
        limit *= 2
    rows = often.where(F.col("df") > limit).toArrow()
    discard(often)
    token, df = (rows.column(c).to_numpy() for c in ("token", "df"))
    order = np.argsort(token)
    return token[order], 1 + df[order] // TEXTS_A_PART


def _joined(documents: DataFrame, n: int, percent: int, bits: int, node_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The table of texts, the classes of equal ones, and the components of the linked classes."""
    spark = documents.sparkSession
    table = _texts(documents, n, node_bits)
    texts, classes = _classes(table)
    heavy = spark.sparkContext.broadcast(_heavy(table))

    rows = _prefixes(texts, n, percent, MOST_L - 1, heavy, bits).repartition(partitions(spark), "token", "part").dropDuplicates(["token", "part", "node"])
    # of a token that is dealt into parts the counts are those of a part; they only choose l
    of_token = Window.partitionBy("token", "part")
    shared = rows.withColumns({"df": F.count("*").over(of_token), "first": F.min(F.struct("pos", "node", "n")).over(of_token)}).where("df > 1 or part > 0")
    of_node = Window.partitionBy("node")
    base = F.col("n") - ceil_share(F.col("n"), percent)
    sums = [F.sum(F.when(F.col("pos") < base + l, F.col("df") - 1)).over(of_node).alias(f"s{l}") for l in range(1, MOST_L + 1)]
    cost = [F.when(F.lit(l) <= ceil_share(F.col("n"), percent), F.coalesce(f"s{l}", F.lit(0)) * F.lit(1 + VERIFY_COST / l)) for l in range(1, MOST_L + 1)]
    matches = shared.select("token", "part", "node", "n", "pos", F.col("first.node").alias("first_node"), F.col("first.n").alias("first_n"), *sums)
    matches = matches.withColumn("l", F.array_position(F.array(*cost), F.array_min(F.array(*cost))).cast("int"))
    prefix = cut(matches.where(F.col("pos") < base + F.col("l")).select("token", "node", "n", "pos", "l", "first_node", "first_n"))
    release(spark)

    # first round: each token's documents against its leader, the one that has the fewest tokens before it
    leaders = prefix.where("node = first_node").select("token", "node", "n", "pos")
    top = leaders.groupBy("token").agg(F.min(F.struct("pos", "node", "n")).alias("t"), F.count("*").alias("parts")).where("parts > 1").select(F.col("token").alias("of"), "t")
    met = [
        prefix.select(F.col("first_node").alias("a"), F.col("first_n").alias("na"), F.col("node").alias("b"), F.col("n").alias("nb")),
        leaders.join(top, F.col("token") == F.col("of")).select(F.col("t.node").alias("a"), F.col("t.n").alias("na"), F.col("node").alias("b"), F.col("n").alias("nb")),
    ]
    stars = cut(met[0].unionByName(met[1]).where((F.col("a") != F.col("b")) & _similar_sizes(F.col("na"), F.col("nb"), percent)).groupBy("a", "b").count().drop("count"))
    release(spark)
    links = _verified(stars, texts, classes, n, percent)
    now = components(links)
    release(spark)

    # second round: all pairs of unconnected documents that share enough prefix tokens. A pair that has o common tokens
    # or more has the first l of them where at least o - l tokens follow, in both documents: other places don't count
    placed = prefix.drop("part", "first_node", "first_n").join(now, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sized = placed.groupBy("token", "component").count().groupBy("token").agg(F.count("*").alias("parts"), F.max_by("component", "count").alias("most"))
    left = cut(placed.join(sized.where("parts > 1").select(F.col("token").alias("of"), "most"), F.col("token") == F.col("of")).drop("of"))
    discard(prefix)
    release(spark)
    b = left.select("token", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "pos", "l", "component")])
    # a pair of different components has one side at least outside the component that holds most of the token's rows
    a = left.where("component <> most").select("token", "most", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "pos", "l", "component")])
    once = (F.col("component_b") == F.col("most")) | (F.col("node_a") < F.col("node_b"))
    both, l = F.col("n_a") + F.col("n_b"), F.least("l_a", "l_b")
    early = [(F.col(f"n_{x}") - F.col(f"pos_{x}") + l - 1) * (100 + percent) >= both * percent for x in "ab"]
    met = a.join(b, "token").where(once & (F.col("component_a") != F.col("component_b")) & _similar_sizes(F.col("n_a"), F.col("n_b"), percent) & early[0] & early[1])
    # the two sides in one order, whichever component is the larger for a token
    swap = F.col("node_a") > F.col("node_b")
    side = lambda c, x, y: F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}"))
    met = met.select(l.alias("l"), *[side(c, x, y).alias(f"{c}_{x}") for c in ("node", "n", "pos") for x, y in ("ab", "ba")])
    met = met.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(
        F.count("*").alias("common"), F.first("l").alias("l"),
        F.least(F.first("n_a") - F.min("pos_a"), F.first("n_b") - F.min("pos_b")).alias("most"), F.first(F.col("n_a") + F.col("n_b")).alias("both"),
    )
    enough = (F.col("common") >= F.col("l")) & (F.col("most") * (100 + percent) >= F.col("both") * percent)
    known = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = _verified(met.where(enough).select("a", "b").join(known, ["a", "b"], "left_anti"), texts, classes, n, percent)
    discard(left, stars)
    ends = components(links.unionByName(more))
    release(spark)
    return texts, classes, ends


def groups(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return similar_documents(documents.select(F.monotonically_increasing_id().alias("id"), "doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def one_of_each(documents: DataFrame, *, n: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` with one row of each group of near copies, the one of the least doc_id; empty texts all stay."""
    marked = cut(documents.select(F.monotonically_increasing_id().alias("id"), packed(documents).alias("own")), compression="zstd")
    texts, grouped = _grouped(marked.select("id", F.col("own.doc_id").alias("doc_id"), F.col("own.text").alias("text")), n, percent)
    found = cut(texts.where("n > 0").select("id", "doc_id", "node").join(grouped.select("node", "component"), "node").select("id", "doc_id", "component"))
    discard(texts)
    release(documents.sparkSession)
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "id")).alias("f"))
    dropped = found.join(first.select(F.col("f.id").alias("id")), "id", "left_anti").select("id")  # by row, not by group
    return marked.join(dropped, "id", "left_anti").select(*own_columns(marked))
