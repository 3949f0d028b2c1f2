"""Chunking: (document_id, text) to (chunk_id, document_id, chunk_index, text, start_offset, end_offset).

All work is on arrays inside one row: no shuffle. A text is cut into pieces and the gaps between them; chunks are joined
from their pieces and placed by running sums of lengths, never cut out by position (which would count from the text's
beginning each time), so the time is linear in the text. Offsets are code points of the whole text, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import SPACE, SPACE_SET, SPACES, TOKEN, let, short_id, starts, strip
from gleaner.settings import Settings

PARAGRAPH, SENTENCE = rf"\n{SPACE}*\n", f"(?<=[.!?]){SPACE}+"
#: Abbreviations after which a sentence goes on.
DOTTED = ("u.s", "e.g", "i.e", "a.m", "p.m", "etc")
TITLES = "dr mr mrs ms prof sr jr st vs gen gov sgt cpl pvt capt lt col maj cmdr adm".split()
_ABBREVIATION = rf"(?iu)(?:^|{SPACE})(?:{'|'.join([d.replace('.', '[.]') for d in DOTTED] + TITLES)}|\p{{L}})$"
_LONGEST = max(map(len, [*DOTTED, *TITLES]))


def _rows(docs: DataFrame, spans: Column) -> DataFrame:
    """A row for each of ``spans`` (start, raw) that isn't blank, stripped."""

    def stripped(s: Column) -> Column:
        lead = F.length(s["raw"]) - F.length(F.ltrim(s["raw"], F.lit(SPACES)))
        return F.struct((s["start"] + lead).alias("start"), strip(s["raw"]).alias("text"))

    out = docs.select("document_id", F.posexplode(F.filter(F.transform(spans, stripped), lambda s: s["text"] != "")).alias("chunk_index", "c"))
    return out.select(
        short_id(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"), "document_id", "chunk_index", F.col("c.text").alias("text"),
        F.col("c.start").alias("start_offset"), (F.col("c.start") + F.length("c.text")).alias("end_offset"),
    )


def ends_with_abbreviation(piece: Column) -> Column:
    """Whether the last word without its dots is an abbreviation or one letter. A few last characters tell."""
    n = _LONGEST + 2
    return piece.endswith(".") & F.substring(F.rtrim(piece, F.lit(".")), -n, n).rlike(_ABBREVIATION)


def _placed(pieces: Column, gaps: Column) -> Column:
    """(piece, gap, at): pieces, the gap after each (none after the last), and where each piece starts, from the first."""
    after = lambda v, i: F.coalesce(F.get(v["gap"], i), F.lit(""))
    sizes = lambda v: F.transform(v["piece"], lambda p, i: F.length(p) + F.length(after(v, i)))
    both = F.struct(pieces.alias("piece"), gaps.alias("gap"))
    return let(both, lambda v: let(starts(sizes(v)), lambda at: F.struct(v["piece"].alias("piece"), v["gap"].alias("gap"), at.alias("at"))))


def _joined(v: Column, first: Column, last: Column) -> Column:
    """The text from one piece to another, both inclusive, gaps between them included."""
    between = F.transform(F.sequence(first, last), lambda i: F.concat(F.get(v["piece"], i), F.when(i < last, F.get(v["gap"], i)).otherwise("")))
    return F.when(first == last, F.get(v["piece"], first)).otherwise(F.array_join(between, ""))


def _cut(pattern: str) -> Column:
    return _placed(F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))


def paragraphs(docs: DataFrame) -> DataFrame:
    spans = let(_cut(PARAGRAPH), lambda v: F.transform(v["piece"], lambda p, i: F.struct(F.get(v["at"], i).alias("start"), p.alias("raw"))))
    return _rows(docs, spans)


def sentences(docs: DataFrame) -> DataFrame:
    """Sentences; a fragment that ends with an abbreviation is joined to the next one."""

    def spans(v: Column) -> Column:
        goes_on = F.transform(v["piece"], ends_with_abbreviation)
        whole = F.sequence(F.lit(0), F.size(v["piece"]) - 1)
        firsts = let(goes_on, lambda on: F.filter(whole, lambda i: (i == 0) | ~F.get(on, i - 1)))

        def span(firsts: Column, i: Column, k: Column) -> Column:
            last = F.coalesce(F.get(firsts, k + 1), F.size(v["piece"])) - 1
            return F.struct(F.get(v["at"], i).alias("start"), _joined(v, i, last).alias("raw"))

        return let(firsts, lambda f: F.transform(f, lambda i, k: span(f, i, k)))

    return _rows(docs, let(_cut(SENTENCE), spans))


def windows(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Windows of ``size`` words, ``size - overlap`` apart; the last ones may lie within the one before."""
    step = max(size - overlap, 1)
    around = F.split("text", TOKEN, -1)  # what stands before the first word, between words, and after the last
    words = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))

    def spans(v: Column, lead: Column) -> Column:
        def span(i: Column) -> Column:
            last = F.least(i + size, F.size(v["piece"])) - 1
            return F.struct((lead + F.get(v["at"], i)).alias("start"), _joined(v, i, last).alias("raw"))

        return F.transform(F.sequence(F.lit(0), F.size(v["piece"]) - 1, F.lit(step)), span)

    def of(around: Column) -> Column:
        return let(_placed(words, F.slice(around, F.lit(2), F.greatest(F.size(around) - 1, F.lit(0)))), lambda v: spans(v, F.length(F.get(around, F.lit(0)))))

    return _rows(docs.where(F.col("text").rlike(f"[^{SPACE_SET}]")), let(around, of))


def chunk(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Chunks of ``docs`` (document_id, text) by the strategy of the settings; blank texts give none."""
    docs = docs.select("document_id", "text").where(F.col("text").rlike(f"[^{SPACE_SET}]"))
    if settings.chunk_strategy == "paragraph":
        return paragraphs(docs)
    if settings.chunk_strategy == "sentence":
        return sentences(docs)
    return windows(docs, settings.chunk_size, settings.chunk_overlap)
