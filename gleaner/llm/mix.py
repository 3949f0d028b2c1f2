"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken ``target / source_size`` times. The whole part of that is taken at once; the
fractional rests are rounded in pairs: words move at random from one document of a pair to the other until one of them
is taken wholly or not at all, which keeps each document's expectation and, exactly, the words of the pair. The rounds
form a reduction tree: documents meet in groups of about ``group_rows`` rows of one source, each group leaves at most
one document undecided, and those meet again, ``fan_in`` groups at a time, until each source has one left, which is
drawn. So a source's words differ from its target by less than one document, however large the source is.

Large documents are rounded first, so that what is left undecided tends to be small. All draws are seeded by the group
and groups depend on doc_id only, so reruns agree whatever the partitions are.

Defined cases: null and wordless texts have size 0 and are never taken; null sources are one source, the last; repeated
rows are rounded row by row; a source without words has target 0; an empty table gives an empty mix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, partitions

WEIGHTS, CAP = (1, 2, 3), 3
GROUP_ROWS, FAN_IN, SEED = 4096, 64, 20260101


def word_count(text) -> F.Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, n, target) from (source, size): the sources share all sizes by weight; a share stops at
    ``cap`` times the source's size and the excess is shared again by weight until no share is above."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    # the rank by code point, without bringing all sources into one partition: places in sorted partitions plus offsets
    placed = cut(
        sources.orderBy(F.col("source").asc_nulls_last()).select(
            "*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("i")
        )
    )
    before, offsets = 0, []
    for row in placed.groupBy("p").count().orderBy("p").toLocalIterator():  # a row for each partition
        offsets.append((row["p"], before))
        before += row["count"]
    spark = sizes.sparkSession
    starts = spark.createDataFrame(offsets, "p int, before long")
    turn = F.pmod(F.col("before") + F.col("i"), F.lit(len(weights)))
    ranked = cut(
        placed.join(F.broadcast(starts), "p").select(
            "source", "source_size", "n", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")).alias("weight")
        )
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    most = F.lit(float(cap)) * F.col("source_size")
    level, full = None, -1
    while True:  # each round holds more sources at their cap; there are few rounds, each one aggregation
        held = F.lit(False) if level is None else F.col("weight") * F.lit(level) > most
        got = ranked.agg(
            F.sum(F.when(held, F.col("source_size")).otherwise(0)).alias("held"),
            F.sum(F.when(held, 0.0).otherwise(F.col("weight"))).alias("weight"),
            F.sum(held.cast("long")).alias("n"),
        ).first()
        if not got["weight"] or got["n"] == full:
            break
        level, full = (total - cap * got["held"]) / got["weight"], got["n"]
    target = F.least(most, F.col("weight") * F.lit(level if level is not None else 0.0))
    return ranked.select("source", "source_size", "n", target.alias("target"))


def round_pairs(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Rounds probabilities to 0 and 1, in the given order, keeping the sum of size * p; what was decided as an array
    (the probability itself where not), and the place of the one left undecided or -1."""
    p = p.astype(float).copy()
    carry = -1
    draws = rng.random(len(p))
    for b in range(len(p)):
        if not 0 < p[b] < 1:
            continue
        if carry < 0:
            carry = b
            continue
        a = carry
        up = min(size[a] * (1 - p[a]), size[b] * p[b])  # words that a can gain from b
        down = min(size[a] * p[a], size[b] * (1 - p[b]))
        if draws[b] * (up + down) < down:
            if size[a] * (1 - p[a]) <= size[b] * p[b]:
                p[b], p[a], left = max(0.0, p[b] - up / size[b]), 1.0, b
            else:
                p[a], p[b], left = min(1.0, p[a] + up / size[a]), 0.0, a
        elif size[a] * p[a] <= size[b] * (1 - p[b]):
            p[b], p[a], left = min(1.0, p[b] + down / size[b]), 0.0, b
        else:
            p[a], p[b], left = max(0.0, p[a] - down / size[a]), 1.0, a
        if not 1e-12 < p[left] < 1 - 1e-12:
            p[left] = round(p[left])
        carry = left if 0 < p[left] < 1 else -1
    return p, carry


def _seed(seed: int, level: int, source: str | None, group: int) -> np.random.Generator:
    name = [-1] if source is None else [*source.encode()]
    return np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, level, group, len(name), *[x + 1 for x in name]])))


def mix(
    documents: DataFrame,
    *,
    weights: tuple[int, ...] = WEIGHTS,
    cap: float = CAP,
    seed: int = SEED,
    group_rows: int = GROUP_ROWS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): how many times the mix takes each document."""
    sizes = cut(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    goal = targets(sizes, weights, cap).withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    start = (
        sizes.join(goal, F.col("source").eqNullSafe(F.col("of")))
        .select(
            "doc_id", "source", "size", "source_size", "target",
            F.when(F.col("size") > 0, whole).otherwise(0).cast("long").alias("copies"),
            F.when(F.col("size") > 0, rate - whole).otherwise(0.0).alias("p"),
            F.ceil(F.col("n") / F.lit(group_rows)).alias("groups"),
        )
        .withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.col("groups")))
    )
    schema = start.schema

    def step(level: int):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            source = None if key[0] is None or key[0] != key[0] else key[0]
            rows = rows.assign(_h=pd.util.hash_array(rows["doc_id"].fillna(-1).astype("int64").to_numpy(), categorize=False))
            rows = rows.sort_values(["size", "_h", "doc_id"], ascending=[False, True, True], kind="stable").drop(columns="_h")
            rng = _seed(seed, level, source, int(key[1]))
            p, left = round_pairs(rows["size"].to_numpy(float), rows["p"].to_numpy(float), rng)
            if left >= 0 and int(rows["groups"].iloc[0]) == 1:  # the last group of its source
                p[left] = float(rng.random() < p[left])
            done = (p == 0) | (p == 1)
            rows["copies"] = rows["copies"] + np.where(done, p, 0).astype("int64")
            rows["p"] = np.where(done, 0.0, p)
            return rows[schema.names]

        return run

    most = goal.agg(F.max(F.ceil(F.col("n") / F.lit(group_rows)))).first()[0] or 0
    decided, waiting, level = [start.where("p = 0")], start.where("p > 0"), 0
    while True:
        after = cut(waiting.repartition(partitions(documents.sparkSession), "source", "grp").groupBy("source", "grp").applyInPandas(step(level), schema))
        decided.append(after.where("p = 0"))
        if most <= 1:
            break
        most, level = -(-most // fan_in), level + 1
        waiting = (
            after.where("p > 0")
            .withColumn("grp", F.floor(F.col("grp") / fan_in))
            .withColumn("groups", F.ceil(F.col("groups") / fan_in))
        )
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies")


def mixture(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words), copies."""
    return mix(documents).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
