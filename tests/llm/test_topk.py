"""Exact top-k against all inner products."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quernstone.llm import topk


def brute(rows, every, k, scale=256, clamp=(-float("inf"), float("inf"))):
    v = []
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            v.append((i, tuple(math.floor(scale * x) for x in e)))
    out = set()
    for q, a in {x for x in v if x[0] % every == 0}:
        best = sorted((-max(clamp[0], min(clamp[1], sum(x * y for x, y in zip(a, b)))), i) for i, b in v if i != q)[:k]
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("block", [7, 4096])
def test_top_k(spark, block):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) * (1 + i % 4) for _ in range(12)]) for i in range(300)]
    same = [0.5] * 12
    rows += [(i, same) for i in range(300, 340)] + [(340, None), (341, [1.0, None]), (342, [float("nan")] * 12), (343, [float("inf")]), (None, same), (344, []), (345, [9.0]), (350, [0.0] * 12)]
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<double>, score int")
    got = {tuple(x) for x in topk.top_k(df, F.col("vec_id") % 10 == 0, block=block).collect()}
    assert got == brute(rows, 10, 5)


@pytest.mark.parametrize("big", [3e5, 1e15, 3e18, 1e200])
def test_wide_components(spark, big):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    rows += [(60, [big, 1.0]), (61, [-big, 1.0, 0.5]), (62, [big, 2.0]), (70, [0.5, 0.5]), (63, [big / 2, big / 2]), (64, [1e308] * 3)]
    got = {tuple(x) for x in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0).collect()}
    least, most = -(10**38) + 1, 10**38 - 1
    assert got == {(q, n, i, max(-(2**63), min(2**63 - 1, s))) for q, n, i, s in brute([x for x in rows if x[0] != 64], 10, 5, clamp=(least, most))}


def test_small_tables(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(0, [1.0])], [(0, [1.0]), (1, [2.0]), (1, [2.0]), (50, [-1.0])], [(0, []), (50, []), (3, [])], [(0, None)]):
        got = {tuple(x) for x in topk.top_k(spark.createDataFrame(rows, kind), F.col("vec_id") % 50 == 0).collect()}
        assert got == brute(rows, 50, 5)
