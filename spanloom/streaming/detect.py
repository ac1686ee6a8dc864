"""Detection over streams: the map-only part of the pipeline runs on each micro-batch, the decoding within ``foreachBatch``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery


def detect_stream(docs: DataFrame, detect: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Runs a batch detector on each micro-batch of a streaming table of documents; a document's detections need no state of other batches.

    ``sink`` gets detections and batch id and must be idempotent by that id, as a batch may come again after a failure.
    """
    def each(batch: DataFrame, number: int) -> None:
        sink(detect(batch), number)

    w = docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
