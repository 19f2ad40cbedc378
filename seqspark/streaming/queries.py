"""Queries as a stream against a fixed collection: each micro-batch is one search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.search import Engine


def search_stream(engine: Engine, queries: DataFrame, subjects: DataFrame, path: str, checkpoint: str, index: DataFrame | None = None) -> StreamingQuery:
    """Writes the alignments of arriving queries (seq_id, residues, length) to path, one folder per batch: repeated batches overwrite their own."""

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        engine.search(batch, subjects, index).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return queries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
