"""Arrow steps on long texts: small batches in and out, the same rows."""

import pyarrow as pa
import pytest

from quernstone.config import ChunkConfig, CoherenceConfig
from quernstone.functions import batches as A
from quernstone.operators import chunks, folds

CFG = ChunkConfig(200, 800, 500, language="en")
TEXTS = [f"{i} starts. " + "Some words run on. " * (3000 if i % 10 == 0 else 100) + "\n\nNext part." for i in range(300)]


class Caught:
    """Stands for a DataFrame and gives the function that would run in the workers."""

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *_):
        return self

    def mapInArrow(self, run, kinds):
        return run


@pytest.mark.parametrize(
    ("step", "rows"),
    [
        (lambda d: chunks.repacked_paragraphs(d, CFG), lambda t: list(enumerate(folds.paragraphs(t, CFG)))),
        (lambda d: chunks.fallback_chunks(d, CFG), lambda t: [(k, c.content, len(c.paragraph_indices)) for k, c in enumerate(folds.fallback_packing([" ".join(p.split()) for p in t.split("\n\n")], CFG))]),
    ],
)
def test_long_texts_pass_in_slices(spark, step, rows):
    spark.conf.unset(A._BATCH_SETTING)
    run = step(Caught(spark))
    assert int(spark.conf.get(A._BATCH_SETTING)) <= A.BATCH
    whole = pa.record_batch({"doc_id": range(len(TEXTS)), "text": TEXTS})
    assert whole.nbytes > 2 * A.SLICE
    parts = list(run(iter([whole, whole.slice(0, 0)])))
    assert max(p.nbytes for p in parts) < 2 * A.SLICE
    got = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    assert got == [(i, *r) for i, t in enumerate(TEXTS) for r in rows(t)]


def test_chunks_of_long_texts_pass_in_slices():
    run = chunks._mapped(CFG, "greedy", chunks.embed_features, CoherenceConfig(), r"\n\s*\n", False)
    whole = pa.record_batch({"doc_id": range(300), "text": ["Some words run on. " * 1000] * 300})
    parts = list(run(iter([whole])))
    assert max(p.nbytes for p in parts) < 4 * A.SLICE < sum(p.nbytes for p in parts)
    every = pa.Table.from_batches(parts).to_pylist()
    assert sorted({r["doc_id"] for r in every}) == list(range(300))
    first = [{k: v for k, v in r.items() if k != "doc_id"} for r in every if r["doc_id"] == 0]
    assert first == [{k: v for k, v in r.items() if k != "doc_id"} for r in every if r["doc_id"] == 299]


def test_slices_keep_rows_and_order():
    batch = pa.record_batch({"x": ["a" * 10, "b" * 5000, None, "", "c" * 10]})
    parts = list(A.slices(iter([batch, batch.slice(0, 0)]), 100))
    assert pa.Table.from_batches(parts).to_pydict()["x"] == batch.to_pydict()["x"]
    assert [p.num_rows for p in parts if p.nbytes > 100] == [1]
