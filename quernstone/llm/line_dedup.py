"""Line dedup by distinct-site spread (operator 8).

A HyperLogLog sketch of the sites is kept per line hash and merged by aggregation. Lines whose estimate lies near the
threshold get an exact distinct count. A line that stands on at least ``min_sites`` sites is boilerplate: it stays in
the document with the smallest doc_id that holds it and goes from all others. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import table, text_or_empty, written

MIN_SITES = 5
#: Estimates within this share of the threshold are counted exactly; over ten standard errors of the sketch.
NEAR = 0.25
LG_K = 12

_TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _split(text: str = "text") -> Column:
    return F.split(text_or_empty(text), "\n", -1)


def _document_key() -> Column:
    """Tells rows apart that share a doc_id but not their text."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def line_table(docs: DataFrame) -> DataFrame:
    """One row (doc_id, dk, pos, h, n, site) per line that isn't blank; h and n are hash and length of the trimmed line."""
    site = F.xxhash64(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    return (
        docs.select("doc_id", _document_key().alias("dk"), site.alias("site"), F.posexplode(_split()).alias("pos", "line"))
        .select("doc_id", "dk", "site", "pos", F.regexp_replace("line", _TRIM, "").alias("line"))
        .filter("line <> ''")
        .select("doc_id", "dk", "pos", F.xxhash64("line").alias("h"), F.length("line").alias("n"), "site")
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, near: float = NEAR) -> DataFrame:
    """Lines (h, n) on at least ``min_sites`` sites, with the smallest doc_id that holds them."""
    spread = lines.groupBy("h", "n").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("about"), F.min("doc_id").alias("first_doc")
    )
    spread = written(spread.filter(F.col("about") >= min_sites * (1 - near)), "spread")
    close = spread.filter(F.col("about") <= min_sites * (1 + near))
    exact = lines.join(close.select("h", "n"), ["h", "n"], "left_semi").groupBy("h", "n").agg(F.countDistinct("site").alias("sites"))
    sure = spread.filter(F.col("about") > min_sites * (1 + near)).select("h", "n", "first_doc")
    return sure.unionByName(close.join(exact.filter(F.col("sites") >= min_sites), ["h", "n"]).select("h", "n", "first_doc"))


def with_drops(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with _q_drop, the positions of the lines that go (null: none)."""
    lines = written(line_table(docs), "lines")
    found = boilerplate(lines, min_sites)
    gone = lines.join(found, ["h", "n"]).filter(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    drops = gone.groupBy(F.col("doc_id").alias("_q_id"), F.col("dk").alias("_q_dk")).agg(F.collect_set("pos").alias("_q_drop"))
    same = F.col("doc_id").eqNullSafe(F.col("_q_id")) & (F.col("_q_key") == F.col("_q_dk"))
    return docs.withColumn("_q_key", _document_key()).join(drops, same, "left").drop("_q_id", "_q_dk", "_q_key")


def kept_text() -> Column:
    kept = F.filter(_split(), lambda x, i: ~F.array_contains(F.col("_q_drop"), i))
    return F.when(F.col("_q_drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; the columns stay as they are.

    Lines end at LF and are compared without ASCII white space around them; blank lines are never removed. Site:
    ``source``; null is a site of its own. A null text stays null, an empty one empty; a document may become empty but
    no row is dropped. Rows that share a doc_id count as one document: if it's the smallest, the line stays in each.
    A null doc_id is the smallest only of lines that no other document holds. An empty table gives an empty one.
    Other columns pass through; names that start with _q_ are taken.
    """
    out = with_drops(docs, min_sites).withColumn("text", kept_text())
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_q_drop").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_drops(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return docs.select(
        "doc_id",
        F.size(_split()).cast("long").alias("n_lines"),
        F.when(F.col("_q_drop").isNull(), F.lit(0)).otherwise(F.size("_q_drop")).cast("long").alias("n_removed"),
        F.md5(F.coalesce(kept_text(), F.lit(""))).alias("kept_md5"),
    )


OP8_SQL = r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key FROM l),
b AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT coalesce('s' || source, 'n')) >= 5),
m AS (SELECT k.doc_id, k.line, k.pos, b.key IS NOT NULL AND k.doc_id IS DISTINCT FROM b.first_doc AS gone FROM k LEFT JOIN b ON k.key = b.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_md5
FROM m GROUP BY doc_id
"""
