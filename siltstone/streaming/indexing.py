"""Chunks that arrive as a stream go into a collection batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.functions.models import Embedder
from siltstone.sources import store


def index_stream(chunks: DataFrame, root: str, collection: str, checkpoint: str, embedder: Embedder | None = None, once: bool = True) -> StreamingQuery:
    """Upsert every micro-batch. Repeating a batch after a failure writes the same points again, so nothing is doubled."""

    def put(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.index_chunks(batch, root, collection, recreate=False, embedder=embedder)

    writer = chunks.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def late_counts(chunks: DataFrame, late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Chunks per window of ingested_at, with a watermark: rows later than `late` are left out by the stream."""
    return chunks.withWatermark("ingested_at", late).groupBy(F.window("ingested_at", window).alias("w")).agg(F.count("*").alias("n")).select("w.start", "w.end", "n")
