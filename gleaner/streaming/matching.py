"""Copied passages of documents that arrive as a stream, against a corpus that stands still."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators import matching
from gleaner.operators.chunk import chunk
from gleaner.settings import Settings


def start(documents: DataFrame, sources: DataFrame, out: str, checkpoint: str, settings: Settings = Settings()) -> StreamingQuery:
    """Writes the merged matches of each batch of ``documents`` (document_id, text) under ``out`` in a folder of its
    own, so that a batch that runs again replaces itself. No state is kept between batches."""

    def batch(rows: DataFrame, number: int) -> None:
        found = matching.merge(matching.matches(chunk(rows, settings), sources, settings))
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
