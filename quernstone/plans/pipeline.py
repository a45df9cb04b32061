"""From files or texts to chunks with quality, statistics and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone import __version__
from quernstone.config import ChunkConfig
from quernstone.operators import markdown
from quernstone.operators.chunks import chunk_documents
from quernstone.operators.quality import evaluate, evaluate_documents, statistics, summary
from quernstone.sources.files import Parser, read_files


class Chunker:
    """Chunks documents with one set of settings."""

    def __init__(self, config: ChunkConfig | None = None, mode: str = "greedy", **how):
        self.config, self.mode, self.how = config or ChunkConfig(), mode, how

    @classmethod
    def preset(cls, name: str, **how) -> Chunker:
        return cls(ChunkConfig.preset(name), **how)

    def texts(self, docs: DataFrame) -> DataFrame:
        """Chunks of (doc_id, text)."""
        return chunk_documents(docs, self.config, self.mode, **self.how)

    def markdown(self, docs: DataFrame) -> DataFrame:
        """Chunks of (doc_id, markdown), with tables and images as elements of their own."""
        found = markdown.elements(docs, language=self.config.language)
        return chunk_documents(markdown.as_documents(found), self.config, self.mode, **self.how)

    def files(self, spark: SparkSession, path: str, parsers: dict[str, Parser] | None = None) -> DataFrame:
        """Chunks of the files under ``path`` that could be read; ``failures`` has the others."""
        return self.markdown(read_files(spark, path, parsers).filter("error IS NULL").select("doc_id", "markdown"))

    def failures(self, spark: SparkSession, path: str, parsers: dict[str, Parser] | None = None) -> DataFrame:
        """(doc_id, path, error) of the files under ``path`` that couldn't be read."""
        return read_files(spark, path, parsers).filter("error IS NOT NULL").select("doc_id", "path", "error")

    def evaluate(self, chunks: DataFrame, docs: DataFrame | None = None) -> DataFrame:
        """Measures and advice per document; with ``docs`` also those that have no chunks."""
        return evaluate(chunks) if docs is None else evaluate_documents(docs, chunks)

    def statistics(self, chunks: DataFrame) -> DataFrame:
        return statistics(chunks)

    def summary(self, chunks: DataFrame) -> DataFrame:
        return summary(chunks)


def processing_statistics(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row over all documents: total_processed, total_errors, fallback_used, success_rate, mean_chunks.

    A document without chunks counts as an error, one whose processing_mode starts with fallback as a fallback. Without
    documents all are 0.
    """
    by_doc = chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("processing_mode").startswith("fallback").cast("int")).alias("fallback"))
    every = docs.select("doc_id").distinct().join(by_doc, "doc_id", "left")
    counts = every.agg(F.count("n").alias("total_processed"), F.count_if(F.col("n").isNull()).alias("total_errors"), F.coalesce(F.sum("fallback"), F.lit(0)).alias("fallback_used"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean_chunks"))
    share = F.col("total_processed") / F.greatest(F.col("total_processed") + F.col("total_errors"), F.lit(1))
    return counts.withColumn("success_rate", share)


def health(errors: int, requests: int, fallback: bool = False, hit_rate: float | None = None) -> dict:
    """Status of a run by its share of failed documents, whether it fell back, and its cache's rate of hits."""
    share = errors / requests if requests else 0.0
    status = "unhealthy" if share > 0.1 else "degraded" if share > 0.05 or fallback else "healthy"
    said = {"error rate over 5 %": share > 0.05, "documents went the way of the fallback": fallback, "fewer than 30 % of vectors came from the cache": hit_rate is not None and hit_rate < 0.3}
    return {"status": status, "error_rate": share, "warnings": [w for w, there in said.items() if there], "fallback_system": "active" if fallback else "standby", "version": __version__}
