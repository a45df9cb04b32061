"""Connected components by alternating large and small stars, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quernstone.llm.common import discard, written


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and its neighbours. Partial sums first, so a hub costs a row per task."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    full = _with_least(down)
    out = full.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(full.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def _round(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The written edges, and their number and sum of hashes, taken while they are written."""
    seen = Observation()
    measures = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")
    now = written(edges.observe(seen, *measures), "edges")
    return now, seen.get


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id that has an edge to a smaller one; component: the smallest id reachable.

    ``edges`` has u and v; loops and repeated edges don't matter. Each round is written, so a lost executor costs no
    earlier round; rounds grow with the logarithm of the longest path.
    """
    now, state = _round(edges.select("u", "v").filter("u <> v").distinct())
    seen = None
    while state["n"] and state != seen:
        last, seen = now, state
        now, state = _round(_small_star(_large_star(last)))
        discard(last)
    out = now.withColumnsRenamed({"u": "id", "v": "component"})
    out._quernstone_path = now._quernstone_path
    return out
