"""Structured Streaming: each micro-batch of new entries becomes a snapshot of basket statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import index
from ..sources.catalog import Catalog


def index_stream(flat: DataFrame, value: str, basket_entries: int, catalog: Catalog, checkpoint: str) -> StreamingQuery:
    """Index a stream of (source_id, entry_id, value) rows; a batch that runs again is published once."""

    def batch(rows: DataFrame, number: int) -> None:
        catalog.publish({"baskets": index.build_baskets(rows, value, basket_entries)}, fingerprint=f"{checkpoint}#{number}")

    return flat.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
