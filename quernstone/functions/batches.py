"""Arrow batches between the JVM and Python workers, kept small in bytes however long the texts are."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch between the JVM and Python, so that long texts don't fill a worker.
BATCH = 8 << 20
#: Bytes of the rows that a step turns into Python objects at once, unless one row is larger.
SLICE = 1 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit on the bytes of an Arrow batch to BATCH; a lower setting stays."""
    found = spark.conf.get(_BATCH_SETTING, None)
    size = re.fullmatch(r"(\d+)([kmg]?)b?", (found or "").lower())
    if not size or not 0 < int(size[1]) * 1024 ** " kmg".index(size[2] or " ") <= BATCH:
        spark.conf.set(_BATCH_SETTING, str(BATCH))


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """All rows of ``batches`` in order, halved until a part has at most ``size`` bytes or one row."""
    for batch in batches:
        waiting = [batch]
        while waiting:
            part = waiting.pop()
            if part.num_rows < 2 or part.nbytes <= size:
                yield part
            else:
                half = part.num_rows // 2
                waiting += [part.slice(half), part.slice(0, half)]
