"""Streams of texts, masked as they come. Substitutes are pure functions, so there is no state and batches and streams agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.mask import mask_pipeline


def mask_stream(texts: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """A streaming DataFrame (doc_id, session_id, text) with spans and masked."""
    return mask_pipeline(texts, rules or ())


def to_memory(stream: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Run what is there into a table in memory; for tests and trials."""
    return stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
