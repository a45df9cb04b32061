"""Chunking of streams: chunking is per document, so a stream of documents maps straight to a stream of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quernstone.config import ChunkConfig
from quernstone.operators.chunks import chunk_documents


def stream_chunks(docs: DataFrame, path: str, checkpoint: str, cfg: ChunkConfig = ChunkConfig(), mode: str = "greedy", once: bool = True) -> StreamingQuery:
    """Writes the chunks of a streaming (doc_id, text) as Parquet under ``path``, each document exactly once."""
    writer = chunk_documents(docs, cfg, mode).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
