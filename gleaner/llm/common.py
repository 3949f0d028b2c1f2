"""What the operators of this subpackage share: the shared folder, sizes, and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters, for lower-casing that leaves every other character as it is.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word of the text contracts: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``. Only a local master, as in tests, may
    leave that unset: elsewhere each executor would write to a disk of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (the master is {master})")
        named = f"file://{tempfile.mkdtemp(prefix='gleaner-')}"
        spark.conf.set("spark.checkpoint.dir", named)
        _file_system(spark, named, "deleteOnExit")
    return named.rstrip("/")


def _file_system(spark: SparkSession, path: str, call: str, *args: object) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    getattr(where.getFileSystem(spark._jsc.hadoopConfiguration()), call)(where, *args)


def cut(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it again: the lineage ends there, and a lost executor
    costs no more than the tasks after it. The table goes when the driver ends, or by ``discard``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gleaner-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    _file_system(spark, path, "deleteOnExit")
    table = spark.read.schema(df.schema).parquet(path)
    table.gleaner_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``cut`` that nothing will read any more."""
    for table in tables:
        _file_system(table.sparkSession, table.gleaner_path, "delete", True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the files of shuffles whose results are tables by now; else they stay until the driver happens
    to collect its garbage."""
    spark._jvm.System.gc()


def free_name(name: str, taken: list[str]) -> str:
    """``name``, made longer until no column is called so (names differ by more than case)."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name += "_"
    return name


def own_columns(df: DataFrame, column: str = "own") -> list[Column]:
    """The columns that were packed into the struct ``column``, as they were."""
    return [F.col(column).getField(f.name).alias(f.name) for f in df.schema[column].dataType]


def packed(df: DataFrame) -> Column:
    """All columns as one struct, so that an operator's own names can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, tables written by ``cut`` hand their rows to Python in Arrow batches of ``rows`` at most: for rows that
    may be large, as a batch is whole in memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a long, b long) by alternating large-star and small-star rounds.

    Returns (node, component): the smallest node reachable, for every node that has an edge. Each round is two
    aggregations with partial sums and two joins, so no neighbourhood is ever gathered in one task; the rounds grow
    with the logarithm of the longest path. Self loops and nulls are dropped; repeated edges count once. An empty
    input gives an empty result.
    """
    now = cut(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node is linked to the least of the node and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        # small star: every smaller neighbour of a node, and the node, are linked to the least neighbour
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lowest, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after = cut(small)
        same = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        was = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if tuple(same) == tuple(was):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
