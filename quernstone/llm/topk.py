"""Exact top-k inner products (operator 7).

Vectors are rotated by the singular vectors of the whole table, so that a few leading coordinates carry most of an
inner product, and each task works through its vectors by descending length. A pair is dropped when the partial sum
over the leading coordinates plus the Cauchy-Schwarz bound of the rest stays under the query's k-th best score so far,
and a query leaves a batch's scan when length times length does. What remains is scored exactly: in 64-bit integers
where no sum can leave them, else in integers of any size.

Queries go out in blocks of a fixed size, each with first thresholds from the longest vectors; a block meets all vectors
in one narrow pass, the best k of each task are written, and its broadcast goes before the next block is read. Neither
the driver nor a plan grows with the number of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import discard, table, trimmed, written

K, EVERY, SCALE = 5, 50, 256
#: Queries in a block (about; they are dealt by hash), the longest vectors that give the first thresholds, rows of a step.
BLOCK, SEEDS, STEP = 4096, 2048, 512
#: Share of the squared length that the leading coordinates carry.
ENERGY = 0.8
#: Pairs that are scored at once.
PAIRS = 16384
#: Largest score of 38 digits, and largest of 64 bits; beyond them scores count as these.
_MOST, _LONG = 10**38 - 1, 2**63 - 1
_OUT = "query_id long, vec_id long, score decimal(38,0)"


def integer_vectors(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components floor(scale * x), whole numbers as doubles, of all rows whose id is there and whose
    components are there and finite before and after scaling."""
    x = F.transform("embedding", lambda c: c.cast("double") * scale)
    # beyond 2^52 every double is whole, and 64 bits may not hold it
    whole = F.transform(x, lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(c))
    fine = F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    return df.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def _length(v: str = "v") -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, c: a + c * c))


def _matrix(vectors, d: int) -> np.ndarray:
    out = np.zeros((len(vectors), d))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _products(v: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of rows i of ``v`` and j of ``q``; integers of any size for pairs that 64 bits might not do for."""
    most_v, most_q = (np.abs(x).max(axis=1, initial=0) for x in (v, q))
    safe = most_v < 2.0**62, most_q < 2.0**62
    narrow_v, narrow_q = (np.where(ok[:, None], x, 0).astype(np.int64) for ok, x in zip(safe, (v, q)))
    out = np.zeros(len(i), np.int64)
    for a in range(0, len(i), PAIRS):
        b = slice(a, a + PAIRS)
        out[b] = np.einsum("nd,nd->n", narrow_v[i[b]], narrow_q[j[b]])
    reach = most_v[i] * most_q[j] * max(1, v.shape[1])
    wide = np.flatnonzero(~(reach < 2.0**62) | ~safe[0][i] | ~safe[1][j])
    if len(wide):
        out = out.astype(object)
        for x in wide.tolist():
            out[x] = max(-_MOST, min(_MOST, sum(int(c) * int(e) for c, e in zip(v[i[x]].tolist(), q[j[x]].tolist()))))
    return out


def _gram(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((d, d))
        for batch in batches:
            x = _matrix(batch["v"].to_numpy(zero_copy_only=False), d).astype(float)
            with np.errstate(over="ignore", invalid="ignore"):
                g += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d), pa.int32()), pa.array(g.ravel())], names=["at", "g"])

    return run


def rotation(vectors: DataFrame, d: int) -> tuple[np.ndarray, int]:
    """The right singular vectors of all rows, by descending value, and how many carry ENERGY. d * d numbers reach the driver."""
    rows = vectors.select("v").mapInArrow(_gram(d), "at int, g double").groupBy("at").agg(F.sum("g").alias("g")).collect()
    g = np.zeros(d * d)
    for r in rows:
        g[r["at"]] = r["g"]
    if not np.isfinite(g).all():  # squares beyond a double: any turn is right, and this one is
        return np.eye(d), d
    values, r = np.linalg.eigh(g.reshape(d, d) / max(np.abs(g).max(), 1e-300))
    values, r = np.maximum(values[::-1], 0), r[:, ::-1].copy()
    share = np.cumsum(values) / max(values.sum(), 1e-300)
    return r, min(d, int(np.searchsorted(share, ENERGY)) + 1)


def _best(q: np.ndarray, s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best of each query, by score and then smaller id."""
    o = np.lexsort((ids, -(s if s.dtype != object else np.unique(s, return_inverse=True)[1]), q))
    first = np.flatnonzero(np.r_[True, q[o][1:] != q[o][:-1]]) if len(o) else np.zeros(0, int)
    rank = np.arange(len(o)) - np.repeat(first, np.diff(np.r_[first, len(o)]))
    return o[rank < k]


class Scan:
    """One task's pass over its vectors for a block of queries."""

    @np.errstate(over="ignore", invalid="ignore")
    def __init__(self, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, r: np.ndarray, h: int, k: int):
        self.ids, self.q, self.r, self.h, self.k = ids, q, r, h, k
        self.floor = floor.astype(float)
        turned = q @ r
        self.lead, self.rest = turned[:, :h], np.linalg.norm(turned[:, h:], axis=1)
        self.length = np.linalg.norm(q, axis=1)
        self.top = tuple(np.zeros(0, np.int64) for _ in range(3))

    @np.errstate(over="ignore", invalid="ignore")
    def step(self, ids: np.ndarray, v: np.ndarray) -> None:
        """Takes the next vectors; what isn't a number in a bound, by overflow, drops nothing."""
        length = np.linalg.norm(v, axis=1)
        slack = 1e-6 + 1e-9 * self.length * length.max(initial=0)
        live = np.flatnonzero(~(self.length * length.max(initial=0) + slack < self.floor))
        if not len(live):
            return
        turned = v @ self.r
        lead, rest = turned[:, : self.h], np.linalg.norm(turned[:, self.h :], axis=1)
        bound = lead @ self.lead[live].T + rest[:, None] * self.rest[live]
        i, j = np.nonzero(~(bound + slack[live] < self.floor[live]))
        j = live[j]
        other = ids[i] != self.ids[j]
        i, j = i[other], j[other]
        score = _products(v, self.q, i, j)
        q, s, c = (np.concatenate(x) for x in zip(self.top, (j, score, ids[i])))
        keep = _best(q, s, c, self.k)
        self.top = q, s, c = q[keep], s[keep], c[keep]
        n = np.bincount(q, minlength=len(self.ids))
        full = np.flatnonzero(n >= self.k)
        last = np.cumsum(n)[full] - 1
        self.floor[full] = np.maximum(self.floor[full], s[last].astype(float))


def _scan(shared, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scan(*shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                part = batch.slice(a, STEP)
                scan.step(part["vec_id"].to_numpy(), _matrix(part["v"].to_numpy(zero_copy_only=False), d))
        q, s, c = scan.top
        score = pa.array([Decimal(int(x)) for x in s], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(scan.ids[q]), pa.array(c), score], names=["query_id", "vec_id", "score"])

    return run


def top_k(df: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query with rows of another id.

    Ties go to the smaller vec_id. Null vectors and ids, and vectors with null or non-finite components (before or after
    scaling), take no part; missing components of shorter vectors count as 0, and an empty vector scores 0 with all.
    Ranks go by exact scores of up to 38 digits; ``score`` is a long, and what is beyond 64 bits shows as the long
    nearest to it. Of rows that repeat id and vector, one asks and each is a candidate. Of equal vectors only the k + 1
    smallest rows are candidates, as no more can count. An empty table gives an empty one. Other columns aren't read.
    """
    spark = df.sparkSession
    vectors = integer_vectors(df, scale)
    alike = Window.partitionBy("v").orderBy("vec_id")
    candidates = vectors.withColumn("n", F.row_number().over(alike)).filter(F.col("n") <= k + 1).withColumn("length", _length()).drop("n")
    candidates = written(candidates.sortWithinPartitions(F.desc("length"), "vec_id"), "vectors")
    asked = vectors.filter(is_query).distinct()
    count, d = asked.count(), candidates.agg(F.max(F.size("v"))).first()[0] or 0
    blocks = -(-count // block)
    if not blocks or not d:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long") if not blocks else _flat(candidates, asked, k)
    queries = written(asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))), "queries", by="block")
    r, h = rotation(candidates, d)
    seeds = candidates.orderBy(F.desc("length"), "vec_id").limit(SEEDS).collect()
    seed_ids, seed_v = np.array([x["vec_id"] for x in seeds]), _matrix([x["v"] for x in seeds], d)
    found = None
    for b in range(blocks):
        own = queries.filter(F.col("block") == b).select("vec_id", "v").collect()
        if not own:
            continue
        ids, q = np.array([x["vec_id"] for x in own]), _matrix([x["v"] for x in own], d)
        first = Scan(ids, q, np.full(len(ids), -np.inf), r, h, k)
        for a in range(0, len(seed_ids), STEP):
            first.step(seed_ids[a : a + STEP], seed_v[a : a + STEP])
        shared = spark.sparkContext.broadcast((ids, q, first.floor, r, h, k))
        part = candidates.select("vec_id", "v").mapInArrow(trimmed(_scan(shared, d)), _OUT)
        found = written(part, "best", into=found)
        shared.destroy()
    discard(queries, candidates)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    shown = F.greatest(F.least("score", F.lit(_LONG).cast("decimal(38,0)")), F.lit(-_LONG - 1).cast("decimal(38,0)")).cast("long")
    return best.select("query_id", "rank", "vec_id", shown.alias("score"))


def _flat(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """All vectors are empty and score 0: the smallest k + 1 ids are enough for every query."""
    least = sorted(r["vec_id"] for r in candidates.select("vec_id").orderBy("vec_id").limit(k + 1).collect())
    near = queries.select(F.col("vec_id").alias("query_id"), F.array(*map(F.lit, least)).cast("array<long>").alias("all"))
    own = near.select("query_id", F.posexplode(F.slice(F.filter("all", lambda x: x != F.col("query_id")), 1, k)).alias("rank", "vec_id"))
    return own.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
