"""Mixing sources to target weights (operator 9).

Tokens are summed per source, a repetition rate follows for each source, and every document is emitted
``floor(rate)`` times plus one more time if a number hashed from its id falls under the fraction. DataFrame functions
only; documents meet the table of sources (one short row each) in one equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import WORD, table, text_or_empty, written

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words the mix takes, as a share of all words.
SHARE = 1.5
#: Times that a source may be repeated at most.
MOST = 2
SEED = "mix-1"


def n_words(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source with its size and target, from rows (source, size).

    Water filling: with sources in ascending order of cap / weight, the level after capping the first k is
    (total - their caps) / (weight of the others); the right level is the largest that does not exceed its own
    source's cap / weight. The window runs over one short row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = by_source.withColumn(
        "w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int"))
    ).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))
    level = weighted.withColumn(
        "level", (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / left
    )
    level = level.withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(whole))
    return level.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("w") * F.col("level")).alias("target"))


def _copies(seed: str) -> Column:
    """Copies of a row with doc_id, source_size and target: the rate's floor, and one more by a hash of the id."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    dice = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return (F.floor(rate) + (dice < rate - F.floor(rate)).cast("int")).cast("int")


def copies(rows: DataFrame, sizes: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """``rows`` (doc_id, source and more) with source_size, target and copies; ``sizes``: all rows' (source, size)."""
    # written, so that its size is known: sent to all tasks if small, else both sides are sorted
    targets = written(source_targets(sizes, **how).withColumnRenamed("source", "_q_source"), "targets")
    joined = rows.join(targets, F.col("source").eqNullSafe(F.col("_q_source"))).drop("_q_source")
    return joined.withColumn("copies", _copies(seed))


def mix(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; the columns stay as they are.

    Nulls: a null text has no words, a null source is a source of its own (last in order), a null doc_id draws from
    the empty string. Rows without words follow their source's rate like all others; a source without words has rate
    0. Repeated rows draw alike. An empty table gives an empty one. Other columns pass through whatever they are
    called; names that start with _q_ are taken.
    """
    own = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_q_row"), "doc_id", "source", n_words().alias("size"))
    sizes = written(packed.select("source", "size"), "sizes")
    taken = copies(packed, sizes, seed, **how).filter("copies > 0")
    return taken.select("_q_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_q_row.*")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words().alias("size"))
    sizes = written(docs, "sizes")
    return copies(sizes, sizes).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 2 * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
      FROM w WINDOW o AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap::DOUBLE, w * (SELECT max(level) FROM l WHERE level <= cap::DOUBLE / w)) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
      ('0x' || substr(md5('mix-1|' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS dice
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (floor(rate) + CASE WHEN dice < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
