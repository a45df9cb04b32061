"""Similarity and boundaries along ordered vectors: windows over (doc_id, pos, embedding)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quernstone.functions.vectors import cosine



def order() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("pos")


def whole() -> WindowSpec:
    return Window.partitionBy("doc_id")


def adjacent(df: DataFrame, similarity=cosine) -> DataFrame:
    """Each row with sim, the cosine with the next row; null for the last."""
    return df.withColumn("sim", similarity(F.col("embedding"), F.lead("embedding").over(order())))


def similarity_matrix(df: DataFrame) -> DataFrame:
    """(doc_id, i, j, sim) with i < j for the rows of each document, an equi-join on the document."""
    a = df.select("doc_id", F.col("pos").alias("i"), F.col("embedding").alias("a"))
    b = df.select("doc_id", F.col("pos").alias("j"), F.col("embedding").alias("b"))
    return a.join(b, "doc_id").filter("i < j").select("doc_id", "i", "j", cosine(F.col("a"), F.col("b")).alias("sim"))


def semantic_boundaries(df: DataFrame, threshold: float = 0.6, window: int = 5) -> DataFrame:
    """(doc_id, boundary): 0, where the smoothed similarity is under the threshold, and the count. None under two rows."""
    half = window // 2
    sims = adjacent(df).filter("sim IS NOT NULL")
    smooth = F.when(F.count("*").over(whole()) > window, F.avg("sim").over(order().rowsBetween(-half, half))).otherwise(F.col("sim"))
    inner = sims.withColumn("smooth", smooth).filter(F.col("smooth") < threshold).select("doc_id", (F.col("pos") + 1).alias("boundary"))
    counts = df.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    ends = counts.select("doc_id", F.explode(F.array(F.lit(0).cast("long"), F.col("n"))).alias("boundary"))
    return inner.select("doc_id", F.col("boundary").cast("long")).unionByName(ends)


def changes(df: DataFrame) -> DataFrame:
    """(doc_id, pos, change) for inner rows: how far the similarities to both neighbours differ."""
    sims = adjacent(df)
    both = sims.withColumn("before", F.lag("sim").over(order())).filter("sim IS NOT NULL AND before IS NOT NULL")
    return both.select("doc_id", "pos", F.abs(F.col("before") - F.col("sim")).alias("change"))


def semantic_shifts(df: DataFrame, sensitivity: float = 0.3) -> DataFrame:
    """(doc_id, rank, pos, change) of changes over the sensitivity, largest first."""
    largest = Window.partitionBy("doc_id").orderBy(F.desc("change"), "pos")
    return changes(df).filter(F.col("change") > sensitivity).select("doc_id", F.row_number().over(largest).alias("rank"), "pos", "change")


def sharp_changes(df: DataFrame) -> DataFrame:
    """Changes over the document's mean plus its standard deviation."""
    limit = F.avg("change").over(whole()) + F.stddev_pop("change").over(whole())
    return changes(df).withColumn("limit", limit).filter("change > limit").drop("limit")


def spaced(df: DataFrame, distance: int = 2) -> DataFrame:
    """Boundaries (doc_id, boundary) from left to right that lie ``distance`` or more after the last kept: a fold per document."""
    kept: Column = F.aggregate(
        F.sort_array(F.collect_set("boundary")), F.array().cast("array<long>"),
        lambda s, x: F.when((F.size(s) == 0) | (x - F.element_at(s, -1) >= distance), F.concat(s, F.array(x))).otherwise(s),
    )
    return df.groupBy("doc_id").agg(kept.alias("kept")).select("doc_id", F.explode("kept").alias("boundary"))


def topic_coherence(df: DataFrame) -> DataFrame:
    """(doc_id, coherence): mean of all cosines that aren't zero; 1 for a single row."""
    pairs = similarity_matrix(df).groupBy("doc_id").agg(F.avg(F.when(F.col("sim") != 0, F.col("sim"))).alias("mean"))
    counts = df.groupBy("doc_id").agg(F.count("*").alias("n"))
    return counts.join(pairs, "doc_id", "left").select("doc_id", F.when(F.col("n") == 1, F.lit(1.0)).otherwise(F.coalesce("mean", F.lit(0.0))).alias("coherence"))


def topic_clusters(df: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, pos, topic): k-means with k = min(max(2, n div 3), 5) clusters per document, by Arrow per group."""
    import numpy as np
    import pyarrow as pa

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        x = np.array(t["embedding"].to_pylist(), float)
        k = min(max(2, len(x) // 3), 5, len(x))
        best = None
        for s in range(10):
            rng = np.random.default_rng(seed + s)
            c = x[rng.choice(len(x), k, replace=False)]
            for _ in range(100):
                own = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
                new = np.array([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(k)])
                if np.allclose(new, c):
                    break
                c = new
            cost = ((x - c[own]) ** 2).sum()
            if best is None or cost < best[0]:
                best = cost, own
        return pa.table({"doc_id": t["doc_id"], "pos": t["pos"].cast(pa.int64()), "topic": pa.array(best[1], pa.int32())})

    return df.select("doc_id", "pos", "embedding").groupBy("doc_id").applyInArrow(run, "doc_id long, pos long, topic int")
