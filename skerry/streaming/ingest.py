"""Indexing a stream: each micro-batch becomes segments of its own, once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.writer import IndexWriter


def index_stream(stream: DataFrame, writer: IndexWriter, checkpoint: str, *, name: str = "ingest", on_rejected=None, **trigger):
    """Start a query that adds each batch of documents and flushes it.

    A batch that is run again after a failure finds its id in the manifest and changes nothing. Rows whose id is
    missing, empty or taken are left out and, as a frame, passed to ``on_rejected(rows, batch_id)``.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        own = f"{name}-{batch_id}"
        if own in writer.manifest.batches:
            return
        if writer._pending:  # logged by a run of this batch that failed before its flush
            writer.wal.truncate()
            writer._pending = []
        rejected = writer.add_documents(batch, on_invalid="reject")
        if on_rejected is not None:
            on_rejected(rejected, batch_id)
        writer.flush(batch_id=own)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
