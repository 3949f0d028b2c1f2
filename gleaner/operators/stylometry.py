"""Six style signals of each chunk, and a document's risk; one projection for the signals, one aggregation after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import SPACE, let, round4, short_id, strip, words
from gleaner.settings import Settings

SENTENCE = f"(?<=[.!?]){SPACE}+"
#: Signals and their weights, in the order of the report.
WEIGHTS = {
    "sentence_length_uniformity": 1.0, "short_sentence_ratio": 1.0, "long_sentence_ratio": 1.0,
    "lexical_diversity": 1.0, "sentence_start_repetition": 0.6, "avg_word_length_uniformity": 1.0,
}


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _uniformity(values: Column) -> Column:
    """1 less the coefficient of variation, within 0 and 1; 0 for fewer than two values. Squares are summed around the
    mean so far, so that doubles come out as the SQL's do, to the last bit."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def step(a: Column, x: Column) -> Column:
        n = a["n"] + 1
        to = lambda mean: F.struct(n.alias("n"), mean.alias("mean"), (a["squares"] + (x - mean) * (x - a["mean"])).alias("squares"))
        return let(a["mean"] + (x - a["mean"]) / n, to)

    def of(v: Column, mean: Column) -> Column:
        n = F.size(v)
        spread = F.sqrt(F.aggregate(v, start, step, lambda a: a["squares"]) / (n - 1))
        return F.when((n < 2) | (mean == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - spread / mean)))

    return let(values, lambda v: let(_sum(v) / F.size(v), lambda mean: of(v, mean)))


def _most_frequent(sorted_values: Column) -> Column:
    """The longest run of equal values of a sorted array."""
    zero = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(a["last"] == x, a["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(a["most"], run).alias("most"))

    return F.aggregate(sorted_values, zero, step, lambda a: a["most"])


def signals(chunks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``chunks`` with the six signals, unrounded; all 0 where there is no sentence."""
    cut = chunks.withColumn("_s", F.filter(F.transform(F.split("text", SENTENCE, -1), strip), lambda s: s != ""))
    cut = cut.withColumn("_w", F.transform("_s", words)).withColumn("_n", F.transform("_w", lambda w: F.size(w).cast("double")))
    cut = cut.withColumn("_all", F.transform(F.flatten("_w"), F.lower)).withColumn("_first", F.array_sort(F.transform("_w", lambda w: F.lower(F.get(w, F.lit(0))))))
    n = F.size("_s")
    share = lambda test: F.size(F.filter("_n", test)) / n
    made = {
        "sentence_length_uniformity": _uniformity(F.col("_n")),
        "short_sentence_ratio": share(lambda x: x <= settings.short_sentence),
        "long_sentence_ratio": share(lambda x: x >= settings.long_sentence),
        "lexical_diversity": F.when(F.size("_all") > 0, 1 - F.size(F.array_distinct("_all")) / F.size("_all")).otherwise(0.0),
        "sentence_start_repetition": F.when(n < 2, 0.0).otherwise((_most_frequent(F.col("_first")) - 1) / n),
        "avg_word_length_uniformity": _uniformity(F.transform("_w", lambda w: _sum(F.transform(w, lambda x: F.length(x).cast("double"))) / F.size(w))),
    }
    made = {k: F.when(n > 0, v).otherwise(0.0) for k, v in made.items()}
    return cut.withColumns(made).drop("_s", "_w", "_n", "_all", "_first")


def weighted(names: dict[str, Column]) -> Column:
    total = sum(WEIGHTS.values())
    top = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        top = top + names[name] * F.lit(weight)
    return top / F.lit(total)


#: What a signal says where it is triggered, and where it isn't.
TOLD = {
    "sentence_length_uniformity": (
        "Sentences are almost all of one length.",
        "The lengths of sentences are varied.",
    ),
    "short_sentence_ratio": (
        "Very short sentences make up much of the text, as in lists and forms.",
        "The share of short sentences is typical.",
    ),
    "long_sentence_ratio": (
        "Very long sentences make up much of the text.",
        "The share of long sentences is typical.",
    ),
    "lexical_diversity": (
        "The same words come back very often.",
        "The choice of words is varied.",
    ),
    "sentence_start_repetition": (
        "Many sentences begin with the same word, as if from a template.",
        "The openings of sentences are varied.",
    ),
    "avg_word_length_uniformity": (
        "Words are about equally long in every sentence.",
        "The lengths of words look natural.",
    ),
}
NOTHING_FOUND = "No signal is raised in this chunk."
CAVEAT = "struct<code:string,message:string,severity:string,scope:string>"
STYLE_ONLY = "Style signals only: they don't replace a reading by a person."
SHORT_TEXT = "Signals of short documents are less reliable."
EXPLAINED = 3


def _texts(which: int) -> Column:
    return F.create_map(*[F.lit(x) for name, said in TOLD.items() for x in (name, said[which])])


def triggered(settings: Settings, suffix: str = "") -> Column:
    """The names of the triggered signals, in the order of the report."""
    return F.array_compact(F.array(*[F.when(F.col(f"{n}{suffix}") >= settings.signal_trigger, F.lit(n)) for n in WEIGHTS]))


def explanation(names: Column) -> Column:
    first = F.transform(F.slice(names, 1, EXPLAINED), lambda n: F.element_at(_texts(0), n))
    return F.when(F.size(names) == 0, NOTHING_FOUND).otherwise(F.array_join(first, " "))


def caveats(n_words: Column, settings: Settings = Settings()) -> Column:
    """array of (code, message, severity, scope) for an analysed document of so many words."""
    one = lambda code, message, severity: F.struct(*[F.lit(x).alias(k) for k, x in (("code", code), ("message", message), ("severity", severity), ("scope", "ai_likelihood"))])
    short = F.when(n_words < settings.short_document_words, one("short_document", SHORT_TEXT, "info"))
    return F.array_compact(F.array(one("stylometric_only", STYLE_ONLY, "warning"), short))


def findings(chunks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(document_id, finding_id, chunk_index, ai_likeness_score, the signals, signals_triggered, explanation) of each
    chunk; the triggered signals joined by commas."""
    s = signals(chunks, settings).withColumn("_hit", triggered(settings))
    score = round4(F.least(weighted({n: F.col(n) for n in WEIGHTS}), F.lit(1.0)))
    return s.select(
        "document_id", F.concat(F.lit("fdg_"), short_id(F.lit("ai"), F.col("document_id"), F.col("chunk_index"), separator="::")).alias("finding_id"), "chunk_index",
        score.alias("ai_likeness_score"), *[round4(F.col(n)).alias(n) for n in WEIGHTS], F.array_join("_hit", ",").alias("signals_triggered"), explanation(F.col("_hit")).alias("explanation"),
    )


def _means(chunks: DataFrame, settings: Settings) -> DataFrame:
    """(document_id, n_words, each signal's mean as ``<name>_raw``) of documents that have chunks. Doubles are summed from
    the last chunk to the first, as the SQL's engine does, whatever the order of rows: at a tie the order decides."""
    s = signals(chunks, settings).select("document_id", F.struct("chunk_index", *WEIGHTS).alias("_v"), F.size(words(F.col("text"))).alias("_n"))
    of = s.groupBy("document_id").agg(F.sort_array(F.collect_list("_v"), asc=False).alias("_v"), F.sum("_n").alias("n_words"))
    return of.select("document_id", "n_words", *[(_sum(F.col(f"_v.{n}")) / F.size("_v")).alias(f"{n}_raw") for n in WEIGHTS])


def risk(chunks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(document_id, the signals' means, signals_triggered, ai_likeness_score, automated_writing_risk,
    human_review_recommended, short_document, caveats) of each document that has chunks."""
    means = _means(chunks, settings)
    rounded = means.select("document_id", "n_words", triggered(settings, "_raw").alias("signals_triggered"), *[round4(F.col(f"{n}_raw")).alias(n) for n in WEIGHTS])
    scored = rounded.withColumn("ai_likeness_score", round4(F.least(weighted({n: F.col(n) for n in WEIGHTS}), F.lit(1.0))))
    tier = F.when(F.col("ai_likeness_score") >= settings.risk_high, "high").when(F.col("ai_likeness_score") >= settings.risk_medium, "medium").otherwise("low")
    return scored.select(
        "document_id", *WEIGHTS, "signals_triggered", "ai_likeness_score", tier.alias("automated_writing_risk"), (tier != "low").alias("human_review_recommended"),
        (F.col("n_words") < settings.short_document_words).alias("short_document"), caveats(F.col("n_words"), settings).alias("caveats"),
    )


def indicator_array(values: dict[str, Column], names: Column) -> Column:
    """array of (signal_name, value, description, triggered) in the order of the report."""

    def one(name: str) -> Column:
        on = F.array_contains(names, name)
        return F.struct(F.lit(name).alias("signal_name"), values[name].alias("value"), F.when(on, TOLD[name][0]).otherwise(TOLD[name][1]).alias("description"), on.alias("triggered"))

    return F.array(*[one(n) for n in WEIGHTS])


def indicators(chunks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(document_id, signal_name, value, description, triggered): six rows for each document that has chunks."""
    r = risk(chunks, settings)
    return r.select("document_id", F.inline(indicator_array({n: F.col(n) for n in WEIGHTS}, F.col("signals_triggered"))))
