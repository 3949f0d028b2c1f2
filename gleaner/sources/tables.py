"""Tables as inputs: how their rows are dealt out."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Tables of up to so many bytes for each core may be dealt out anew: what moves is bounded, whatever the data are.
SMALL = 32 << 20


def spread(table: DataFrame) -> DataFrame:
    """A small table over all cores: a file with one row group is read by one task, which work on its texts would then
    keep. Larger tables are read as they are, without a shuffle."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(cores) if size <= SMALL * cores else table
