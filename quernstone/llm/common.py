"""What the operators of this subpackage share: reading tables and writing intermediate ones."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.batches import small_batches

#: The bytes that separate words everywhere in this subpackage: space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim() -> None:
    """Gives what a Python worker has freed back to the system: idle workers wait in the executor for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``step`` for mapInArrow, after which the worker's free memory goes back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            trim()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's spark.checkpoint.dir, else its context's checkpoint folder. Where neither is set a temporary one
    serves local sessions; on a cluster that is an error, as each executor would write to a disk of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[[^,\]]*(,[^,\]]*)?\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quernstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, what: str, by: str | None = None, into: DataFrame | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, in folders by the column ``by``: cuts the lineage and is computed once.

    With ``into``, a table of this function, the rows are added to it and it is returned, read anew. The files go with ``discard`` or when the driver ends; a lost executor loses nothing, since all others can read them.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = into._quernstone_path if into is not None else f"{shared_dir(spark)}/quernstone-{what}-{uuid.uuid4().hex}"
    to = df.write.mode("append").option("compression", "zstd")
    (to.partitionBy(by) if by else to).parquet(path)
    if into is None:
        atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quernstone_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of ``written`` that no later step reads."""
    for t in tables:
        if path := getattr(t, "_quernstone_path", None):
            _remove(t.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of what has been written and is no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
