"""Personal data: base patterns, and terms that disclose them by co-occurrence. DataFrame functions only.

Base spans are emails, IP addresses, card and phone numbers, leftmost and non-overlapping for each kind, in code
points. Every distinct value is a protected entity e. Over the whole corpus, by whole documents,

    n(e), n(t), n(e, t) = documents that mention e, hold the word t, mention e and hold t outside base spans
    N = documents;  PMI(t; e) = log(n(e, t) N / (n(t) n(e)));  IC(e) = log(N / n(e))

and t discloses e if n(e, t) >= ``SUPPORT`` and PMI(t; e) >= 3/4 IC(e), that is, (n(e, t) / n(t))**4 N >= n(e). A word
that discloses any entity is a span of kind ``term`` wherever it stands outside base spans, in documents without
mentions too. In ``sanitised`` texts base spans become the name of their kind; terms that disclose an entity wholly
(PMI = IC) are removed, the others generalised to ``<term>``.

Patterns are written with possessive loops and an anchor for where matches may begin; they match what the plain ones
match, without backtracking over long runs and without recursion.

Defined cases: null texts are empty; null or repeated ids and repeated rows are rows of their own; a span of a later
kind that overlaps an earlier one is reported, and replaced together with it; words of fewer than ``LETTERS`` code
points, words that touch base spans, and words that hold U+FDD0 (no character, here the mark of a base span) disclose
nothing; columns of any other names come back as they were; an empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import let, starts

from .common import ascii_lower, cut, own_columns, packed

SUPPORT, LETTERS, BROADCAST_TERMS, FILTER_BITS = 2, 3, 500_000, 25
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
VALID_IP = rf"^{_PART}(?:\.{_PART}){{3}}$"
TERM, BETWEEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MARK = "\ufdd0"
SPAN = "array<struct<start:int,end:int,value:string>>"


def located(matches: Column, gaps: Column) -> Column:
    """Spans of matches from the texts between them. Lengths are summed by blocks, so that many matches in a text
    cost little more than linear time."""

    def spans(v: Column) -> Column:
        before = F.transform(v["m"], lambda m, i: F.length(m) + F.length(F.get(v["g"], i)))

        def span(m: Column, i: Column, at: Column) -> Column:
            start = F.get(at, i) + F.length(F.get(v["g"], i))
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"))

        return let(starts(before), lambda at: F.transform(v["m"], lambda m, i: span(m, i, at)))

    return let(F.struct(matches.alias("m"), gaps.alias("g")), spans)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    n = F.length(number)

    def add(a: Column, i: Column) -> Column:
        d = F.substr(number, n - i, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 1, F.when(d >= 5, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(VALID_IP)
    n = F.length(digits(value))
    if kind == "phone":
        return n.between(8, 15)
    return F.when(n.between(16, 19), luhn(digits(value))).otherwise(False)


def _spans(text: Column, found: Column, pattern: str) -> Column:
    return F.when(F.size(found) > 0, located(found, F.split(text, pattern, -1))).otherwise(F.array().cast(SPAN))


def detect(documents: DataFrame) -> DataFrame:
    """(row, own, given, text, base) of every document: all its columns but the text as a struct, whether it has a text,
    the text, and the array of (kind, start, end, entity). The text stands in a row once, as rows are moved."""
    others = documents.drop("text")
    own = packed(others) if others.columns else F.struct(F.lit(0).alias("none"))
    docs = documents.select(
        F.monotonically_increasing_id().alias("row"), own.alias("own"), F.col("text").isNotNull().alias("given"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    signs = {"email": "@", "ip": ".", "phone": "+"}
    for kind in KINDS:
        found = F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))
        if kind in signs:
            found = F.when(F.contains("text", F.lit(signs[kind])), found).otherwise(F.array().cast("array<string>"))
        docs = docs.withColumn(kind, found)
    for kind in KINDS:
        docs = docs.withColumn(kind, _spans(F.col("text"), F.col(kind), PATTERNS[kind]))

    def entity(kind: str, value: Column) -> Column:
        return F.concat(F.lit(f"{kind}:"), ascii_lower(value) if kind == "email" else value if kind == "ip" else digits(value))

    def of(kind: str) -> Column:
        good = F.filter(kind, lambda s: valid(kind, s["value"]))
        return F.transform(good, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), entity(kind, s["value"]).alias("entity")))

    return docs.select("row", "own", "given", "text", F.concat(*[of(kind) for kind in KINDS]).alias("base"))


def _spliced(text: Column, cuts: Column) -> Column:
    """``text`` with every span of ``cuts`` (start, end, to; sorted) replaced; one that overlaps an earlier one goes with
    it. Pieces are joined once, so the time is linear in the number of cuts but for finding their places."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        piece = F.concat(F.substr(text, a["at"] + 1, s["start"] - a["at"]), s["to"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(fresh, F.concat(a["out"], F.array(piece))).otherwise(a["out"]).alias("out"))

    return F.aggregate(cuts, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, a["at"] + 1)))


def _distinct_terms(text: Column) -> Column:
    """The distinct words of a text that may disclose, in ASCII lower case."""
    return F.filter(F.array_distinct(F.split(ascii_lower(text), BETWEEN, -1)), lambda w: (F.length(w) >= LETTERS) & ~F.contains(w, F.lit(MARK)))


def _small(terms: DataFrame) -> DataFrame:
    return F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms


def _parted(found: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``found`` in two parts: all that has one of ``rows``, with little more, and the rest. A filter of ``FILTER_BITS`` at
    most tells, so that a join by row moves the texts of the first part only."""
    bits = min(FILTER_BITS, max(6, math.ceil(math.log2(16 * rows.count() + 1))))
    bit = F.expr("shiftleft(1L, cast(xxhash64(row) & 63 as int))")
    place = F.shiftright(F.xxhash64("row").bitwiseAND((1 << bits) - 1), 6).cast("int")
    masks = rows.groupBy(place.alias("place")).agg(F.bit_or(bit).alias("mask"))
    every = found.sparkSession.range(1 << (bits - 6)).join(masks, F.col("id") == F.col("place"), "left").select("id", F.coalesce("mask", F.lit(0)).alias("mask"))
    held = every.agg(F.sort_array(F.collect_list(F.struct("id", "mask"))).alias("held")).select(F.col("held.mask").alias("held"))
    may = F.get(held.scalar(), place).bitwiseAND(bit) != 0
    return found.where(may), found.where(~may)


def disclosing(found: DataFrame, *, support: int = SUPPORT) -> DataFrame:
    """(term, whole) of the terms that disclose an entity; ``found``: row, text, base of all documents."""
    # n(e, t) is n(e) at most: entities of fewer mentions than the support have no terms
    entities = cut(found.where(F.size("base") > 0).select("row", F.explode(F.array_distinct(F.transform("base", lambda b: b["entity"]))).alias("entity")))
    of = entities.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= support)
    telling = cut(entities.join(of, "entity").select("row", "entity", "n_e"))
    rows = telling.groupBy("row").agg(F.collect_list(F.struct("entity", "n_e")).alias("e"))
    # a base span is one mark that belongs to words, so a word that touches one holds the mark
    marks = F.array_sort(F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.lit(MARK).alias("to"))))
    held = _parted(found, telling)[0].join(rows, "row").select("e", F.explode(_distinct_terms(_spliced(F.col("text"), marks))).alias("term"))
    pairs = cut(held.select("term", F.explode("e").alias("e")).groupBy("e.entity", "e.n_e", "term").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= support))
    # n(t) is asked for words of pairs only, in all documents
    asked = cut(pairs.select("term").distinct())
    holding = found.select(F.explode(_distinct_terms(F.col("text"))).alias("term")).join(_small(asked), "term").groupBy("term").agg(F.count("*").alias("n_t"))
    n, share = found.count(), F.col("n_et") / F.col("n_t")
    told = pairs.join(holding, "term").where(share * share * share * share * F.lit(float(n)) >= F.col("n_e"))
    return told.groupBy("term").agg(F.max(F.col("n_et") == F.col("n_t")).alias("whole"))


def marked(documents: DataFrame, *, support: int = SUPPORT) -> DataFrame:
    """``detect`` with ``terms``: the array of (start, end, whole) of the disclosing terms of each document."""
    found = cut(detect(documents), compression="zstd")
    told = cut(disclosing(found, support=support))
    words = found.select("row", F.explode(_distinct_terms(F.col("text"))).alias("term"))
    hits = words.join(_small(told), "term").groupBy(F.col("row").alias("of"))
    hits = cut(hits.agg(F.collect_list(F.when(F.col("whole"), F.col("term"))).alias("all_told"), F.collect_list("term").alias("told")))
    inside, outside = _parted(found, hits.select(F.col("of").alias("row")))
    touched = inside.join(hits, F.col("row") == F.col("of"), "left")

    def places(lower: Column) -> Column:
        wanted = F.filter(_spans(lower, F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)), TERM), lambda w: F.array_contains("told", w["value"]))
        outside = F.filter(wanted, lambda w: ~F.exists("base", lambda b: (w["start"] <= b["end"]) & (b["start"] <= w["end"])))
        return F.transform(outside, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.array_contains("all_told", w["value"]).alias("whole")))

    none = F.array().cast("array<struct<start:int,end:int,whole:boolean>>")
    terms = F.when(F.col("told").isNotNull(), let(ascii_lower(F.col("text")), places)).otherwise(none)
    kept = ["row", "own", "given", "text", "base"]
    return touched.select(*kept, terms.alias("terms")).unionByName(outside.select(*kept, none.alias("terms")))


def _is(kind: str):
    return lambda b: b["kind"] == kind


def listed(kind: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(":", kind, start.cast("string"), end.cast("string"))


def personal_data(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    base = F.transform("base", lambda b: listed(b["kind"], b["start"], b["end"]))
    more = F.transform("terms", lambda t: listed(F.lit("term"), t["start"], t["end"]))
    return marked(documents.select("doc_id", "text")).select(
        F.col("own.doc_id").alias("doc_id"),
        *[F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, more), ",").alias("spans"),
    )


def sanitised(documents: DataFrame, *, support: int = SUPPORT) -> DataFrame:
    """``documents`` with the personal data and disclosing terms of ``text`` replaced or removed."""
    found = marked(documents, support=support)
    cuts = F.array_sort(
        F.concat(
            F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.concat(F.lit("<"), b["kind"], F.lit(">")).alias("to"))),
            F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["whole"], "").otherwise("<term>").alias("to"))),
        )
    )
    new = F.when(F.size("base") + F.size("terms") > 0, _spliced(F.col("text"), cuts)).when(F.col("given"), F.col("text"))
    own = {f.name: c for f, c in zip(found.schema["own"].dataType, own_columns(found), strict=True)}
    return found.select(*[own.get(c, new.alias(c)) for c in documents.columns])
