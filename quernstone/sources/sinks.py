"""Chunks written and read back."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.config import ChunkConfig
from quernstone.operators.quality import statistics


def save_parquet(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    chunks.write.mode(mode).parquet(path)


def as_json(chunks: DataFrame, cfg: ChunkConfig) -> DataFrame:
    """One JSON object per document: its chunks in order, their statistics and the settings."""
    one = F.struct(F.col("chunk_id").alias("id"), "content", "semantic_score", "token_count", F.size("paragraph_indices").alias("paragraph_count"), "chunk_type", "metadata")
    grouped = chunks.withColumn("_q_one", F.to_json(one)).groupBy("doc_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_id", "_q_one"))), lambda x: x["_q_one"]), ",").alias("chunks")
    )
    stats = statistics(chunks, "doc_id")
    told = stats.select("doc_id", F.to_json(F.struct(*[c for c in stats.columns if c != "doc_id"])).alias("statistics"))
    return grouped.join(told, "doc_id").select("doc_id", F.concat(F.lit('{"chunks":['), "chunks", F.lit('],"statistics":'), "statistics", F.lit(f',"config":{cfg.to_json()}}}')).alias("value"))


def save_json(chunks: DataFrame, path: str, cfg: ChunkConfig) -> None:
    as_json(chunks, cfg).select("value").write.mode("overwrite").text(path)


def load_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, removed when the driver ends; a local session may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[[^,\]]*(,[^,\]]*)?\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quernstone-")
    path = f"{folder.rstrip('/')}/quernstone-{what}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
