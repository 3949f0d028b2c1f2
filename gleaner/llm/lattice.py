"""Near copies among embeddings by lattice hashing.

Each of several tables projects a vector to ``blocks`` times eight random dimensions and decodes each eight to the
nearest point of the E8 lattice: the vector's cell. It also looks into the neighbouring cells that lie nearest to it
(minimal vectors of the lattice away). Vectors that meet in a cell are compared by cosine, in double precision.

Blocks grow with the logarithm of the number of vectors, so that a cell holds about as many at every size, and with
blocks grow tables and probes, so that recall stays; a pair at the threshold is missed by all tables with a probability
of under 0.001. Cells of more than ``CELL`` vectors are cut into parts that meet in pairs, each in a task of its own.
A pair is counted in the first table in which it meets, so pairs are never gathered; components need only a spanning
forest of each cell's links.

Vectors that are equal are one, with a weight: copies cost nothing.

Defined cases: null and zero vectors, and ones with null or non-finite components, link with nothing; vectors of
different length never link; equal rows are other vectors of each other; rows without vec_id are counted as vectors but
name no component unless all rows of it lack one; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, components, cut, partitions

THRESHOLD, SCALE, CELL, SEED = 0.95, 0.5, 4096, 20260101
#: About how many cells a block has for unit vectors at ``SCALE``, and how many vectors a cell may hold on average.
CELLS, OCCUPANCY = 330, 256


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, twice as long, so that they are whole numbers."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((-2, 2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [s for s in product((-1, 1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(out, dtype=np.int64)


ROOTS = minimal_vectors()


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest whole points with an even sum."""
    f = np.rint(x)
    odd = np.flatnonzero(f.sum(axis=1) % 2 != 0)
    gap = x[odd] - f[odd]
    worst = np.abs(gap).argmax(axis=1)
    f[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return f


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8 to rows of eight, twice as large."""
    whole, half = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.rint(2 * np.where(nearer[:, None], half, whole)).astype(np.int64)


class Hashing:
    def __init__(self, n: int, seed: int = SEED) -> None:
        self.blocks = max(1, round(np.log(max(n, 1) / OCCUPANCY) / np.log(CELLS)))
        self.tables, self.probes, self.seed = 1 + 3 * self.blocks, 6 * self.blocks, seed
        rng = np.random.Generator(np.random.PCG64(seed))
        # cells are known by a sum over their coordinates, so a neighbour's key is the home's plus a constant
        self.factors = rng.integers(-(1 << 62), 1 << 62, (self.tables, self.blocks, 8))
        self.moves = np.stack([(ROOTS @ self.factors[t].T).T.ravel() for t in range(self.tables)])  # by table, block and root

    def signatures(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, tables) cells and (n, tables, probes) places of moves to the probed cells."""
        n, d = unit.shape
        homes, probes = np.empty((n, self.tables), np.int64), np.empty((n, self.tables, self.probes), np.int16)
        for t in range(self.tables):
            rng = np.random.Generator(np.random.PCG64([self.seed, d, t]))
            x = (unit @ rng.standard_normal((d, 8 * self.blocks)) * SCALE).reshape(n * self.blocks, 8)
            points = decode(x)
            homes[:, t] = (points.reshape(n, self.blocks, 8) * self.factors[t]).sum(axis=(1, 2)) + d
            toward = ((x - points / 2) @ (ROOTS / 2).T).reshape(n, self.blocks * len(ROOTS))
            probes[:, t] = np.argpartition(-toward, self.probes - 1, axis=1)[:, : self.probes]
        return homes, probes


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _units(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column whose lists are equally long."""
    x = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _signed(vectors: DataFrame, hashing: Hashing) -> DataFrame:
    """Each vector with its signature, and a row for its cell in each table and for each cell it looks into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("v").value_lengths())
            for d in np.unique(sizes):
                part = batch.filter(pa.array(sizes == d))
                unit = _units(part.column("v"))
                homes, probes = hashing.signatures(unit)
                n, rows = len(unit), 1 + hashing.probes
                keys = np.concatenate([homes[:, :, None], homes[:, :, None] + np.take_along_axis(hashing.moves[None], probes.reshape(n, hashing.tables, -1).astype(np.int64), axis=2)], axis=2)
                whole = np.repeat(np.arange(n), hashing.tables * rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.tile(np.repeat(np.arange(hashing.tables, dtype=np.int32), rows), n)), pa.array(keys.ravel()),
                        pa.array(np.tile(np.arange(rows) > 0, n * hashing.tables)),
                        part.column("id").take(pa.array(whole)), part.column("m").take(pa.array(whole)),
                        pa.array([x.tobytes() for x in unit.astype(np.float64)], pa.binary()).take(pa.array(whole)),
                        pa.array([a.tobytes() + b.tobytes() for a, b in zip(homes, probes, strict=True)], pa.binary()).take(pa.array(whole)),
                    ],
                    names=["t", "cell", "probe", "id", "m", "unit", "signature"],
                )

    return vectors.mapInArrow(run, "t int, cell long, probe boolean, id long, m long, unit binary, signature binary")


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between places a and b."""
    parent: dict[int, int] = {}
    out = []

    def top(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        i, j = top(x), top(y)
        if i != j:
            parent[max(i, j)] = min(i, j)
            out.append((x, y))
    return out


def _meetings(hashing: Hashing, threshold: float):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        t = key[0].as_py()
        role, ids, m = (rows.column(c).to_numpy() for c in ("role", "id", "m"))
        unit = np.frombuffer(b"".join(rows.column("unit").to_pylist()), dtype=np.float64).reshape(len(ids), -1)
        raw = np.frombuffer(b"".join(rows.column("signature").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
        homes = raw[:, : 8 * hashing.tables].copy().view(np.int64)
        probes = raw[:, 8 * hashing.tables :].copy().view(np.int16).reshape(len(ids), hashing.tables, hashing.probes)
        stored = np.flatnonzero(role == 0)
        left, right = [], []
        for kind in (0, 1, 2):  # of this part, homes of other parts, and those that look in from other cells
            own = np.flatnonzero(role == kind)
            for s in range(0, len(own), 1024):
                i, j = np.nonzero(unit[own[s : s + 1024]] @ unit[stored].T >= threshold)
                i, j = own[s + i], stored[j]
                ok = ids[i] != ids[j] if kind == 2 else ids[i] < ids[j]
                if len(i):
                    left.append(i[ok])
                    right.append(j[ok])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        swap = ids[a] > ids[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        here = np.where(role[a] == 2, 2, np.where(role[b] == 2, 1, 0))  # how they meet here
        first = np.ones(len(a), dtype=bool)
        for u in range(t + 1):
            ha, hb = homes[a, u], homes[b, u]
            met = [ha == hb, (hb[:, None] + hashing.moves[u][probes[b, u]] == ha[:, None]).any(axis=1), (ha[:, None] + hashing.moves[u][probes[a, u]] == hb[:, None]).any(axis=1)]
            for how, x in enumerate(met):
                first &= ~x if u < t else ~(x & (how < here))
        a, b = a[first], b[first]
        n = np.bincount(a, m[b], len(ids)) + np.bincount(b, m[a], len(ids))
        some = np.flatnonzero(n)
        edges = _forest(a, b)
        return pa.table(
            {
                "a": pa.array([*ids[some].tolist(), *(int(ids[x]) for x, _ in edges)], pa.int64()),
                "b": pa.array([*[None] * len(some), *(int(ids[y]) for _, y in edges)], pa.int64()),
                "n": pa.array([*n[some].astype(np.int64).tolist(), *[0] * len(edges)], pa.int64()),
            }
        )

    return run


def near_copies(embeddings: DataFrame, *, threshold: float = THRESHOLD, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``embeddings`` (vec_id, embedding)."""
    spark = embeddings.sparkSession
    rows = embeddings.select("vec_id", F.when(usable(F.col("embedding")), F.col("embedding")).alias("v"))
    distinct = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"))
    vectors = cut(distinct.withColumn("id", F.monotonically_increasing_id()))
    hashing = Hashing(vectors.count(), seed)
    with batches_of(spark, 512):
        signed = cut(_signed(vectors.select("id", "m", "v"), hashing))
        crowded = signed.where("not probe").groupBy("t", "cell").count().where(F.col("count") > CELL).select("t", "cell", F.ceil(F.col("count") / CELL).cast("int").alias("parts"))
        parts = signed.join(cut(crowded), ["t", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        dealt = parts.withColumn("own", own).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        role = F.when(F.col("probe"), 2).when(F.col("own") == F.col("part"), 0).otherwise(1)
        group = dealt.select("t", "cell", "part", role.alias("role"), "id", "m", "unit", "signature").repartition(partitions(spark), "t", "cell", "part")
        found = cut(group.groupBy("t", "cell", "part").applyInArrow(_meetings(hashing, threshold), "a long, b long, n long"))
    links = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    ends = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "id")
    grouped = vectors.join(ends, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    known = grouped.join(least, "component").join(links, "id", "left").select(F.col("v").alias("of"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    joined = rows.join(known, F.col("v") == F.col("of"), "left")
    component = F.when(F.col("of").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
