"""Quality measures and statistics of chunks (doc_id, chunk_id, content, …), as columns, windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.functions.vectors import feature_cosine, text_features

WEIGHTS = {"avg_coherence": 0.3, "avg_completeness": 0.25, "length_balance": 0.15, "avg_semantic_density": 0.15, "boundary_quality": 0.15}
#: What a document is told, by measure (fixed values).
ADVICE = {
    "coherence": "建议调整语义阈值，提高切片内部连贯性",
    "completeness": "建议优化切片边界，确保在句子或段落边界处切分",
    "balance": "存在长度差异过大的切片，建议分割长切片或合并短切片",
    "density": "部分切片语义密度较低，可能包含过多重复或无关内容",
    "boundary": "建议提高语义阈值或调整重叠比例，改善切片边界质量",
    "poor": "整体切片质量较低，建议重新调整配置参数",
    "good": "切片质量良好，可以用于后续处理",
}


def completeness(c: Column) -> Column:
    """1 less what an unfinished end or a short start costs, 0.1 at least; counted in tenths, so that equal costs give equal doubles."""
    end = T.rstrip(c)
    minus = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0))
    cost = minus(~end.rlike("[。.！!？?；;]$"), 3) + minus(F.length(F.substring_index(c, "。", 1)) < 10, 2) + minus(end.rlike(r"(\((续|未完)\)|（(续|未完)）)$"), 4)
    return F.greatest(F.lit(1), 10 - cost - minus(end.rlike(r"(\.\.\.|……)$"), 2) - minus(end.endswith("详见"), 2)) / 10.0


def density(c: Column) -> Column:
    """Share of distinct words, and how much the sentences' lengths vary."""
    sizes = F.transform(T.quality_sentences(c), lambda s: F.size(T.words(s)).cast("double"))
    sums = lambda n, total, squares: F.struct(n.alias("n"), total.alias("total"), squares.alias("squares"))
    spread = lambda s: F.sqrt(F.greatest(s["n"] * s["squares"] - s["total"] * s["total"], F.lit(0.0))) / s["n"]
    varied = F.aggregate(
        sizes, sums(F.lit(0.0), F.lit(0.0), F.lit(0.0)), lambda s, x: sums(s["n"] + 1.0, s["total"] + x, s["squares"] + x * x),
        lambda s: F.when(s["n"] > 1, F.least(F.lit(1.0), spread(s) / (s["total"] / s["n"] + 1e-6))).otherwise(F.lit(0.0)),
    )
    distinct = lambda w: F.size(F.array_distinct(F.transform(F.filter(w, lambda x: x.rlike(r"^\p{L}+$")), F.lower)))
    return T.bound(T.words(c), lambda w: F.when(F.size(w) == 0, F.lit(0.0)).otherwise(0.7 * distinct(w) / F.size(w) + 0.3 * varied))  # multiplied first: 20 of 35 words make 0.4, and not a little less


def inner_coherence(c: Column) -> Column:
    """Mean cosine of neighbouring sentences' features; 1 for one sentence."""
    pairs = lambda v: F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), feature_cosine)
    mean = lambda p: F.aggregate(p, F.lit(0.0), lambda s, x: s + x) / F.size(p)
    return T.bound(F.transform(T.quality_sentences(c), text_features), lambda v: F.when(F.size(v) < 2, F.lit(1.0)).otherwise(T.bound(pairs(v), mean)))


def _with_boundaries(chunks: DataFrame, **keep: Column) -> DataFrame:
    """(doc_id, chunk_id, ``keep``, score): score of the boundary with the next chunk, null for the last. Features and not texts are shuffled."""
    c = F.col("content")
    ends = F.right(c, F.lit(100)).alias("_q_tail"), F.left(c, F.lit(100)).alias("_q_head")
    bonus = F.when(T.ends_with_stop(c, semicolon=False), 0.2).otherwise(0.0).alias("_q_stop"), F.when(T.lstrip(c).rlike("^[第章节一二三四五]"), 0.1).otherwise(0.0).alias("_q_opening")
    texts = chunks.select("doc_id", "chunk_id", *[v.alias(k) for k, v in keep.items()], *ends, *bonus)
    narrow = texts.withColumns({k: F.when(F.col(k).isNotNull(), text_features(F.col(k))) for k in ("_q_tail", "_q_head")})
    after = lambda k: F.lead(k).over(Window.partitionBy("doc_id").orderBy("chunk_id"))
    paired = narrow.withColumns({"_q_next": after("_q_head"), "_q_next_opening": after("_q_opening")})
    score = 1 - feature_cosine(F.col("_q_tail"), F.col("_q_next")) + F.col("_q_stop") + F.col("_q_next_opening")
    return paired.select("doc_id", "chunk_id", *keep, F.when(F.col("_q_next").isNotNull(), F.least(F.lit(1.0), score)).alias("score"))


def boundary_scores(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, score) of each chunk's boundary with the next."""
    return _with_boundaries(chunks).filter("score IS NOT NULL")


def length_balance(size: Column) -> Column:
    return F.when(F.count("*") < 2, F.lit(1.0)).when(F.avg(size) == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.stddev_pop(size) / F.avg(size)))


def evaluate(chunks: DataFrame) -> DataFrame:
    """One row of measures and advice per document; chunks need coherence_score or semantic_score."""
    coherence = F.col("coherence_score" if "coherence_score" in chunks.columns else "semantic_score")
    limited = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    c, size = F.col("content"), F.col("_q_size")
    measured = _with_boundaries(chunks, _q_size=F.length("content"), _q_coherence=limited(coherence), _q_completeness=limited(completeness(c)), _q_density=limited(density(c)))
    out = measured.groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"), F.avg("_q_coherence").alias("avg_coherence"), F.avg("_q_completeness").alias("avg_completeness"),
        length_balance(size).alias("length_balance"), F.avg("_q_density").alias("avg_semantic_density"), (F.max(size) / (F.min(size) + 1)).alias("spread"),
        F.avg(size).alias("avg_length"), F.min(size).alias("min_length"), F.max(size).alias("max_length"), F.coalesce(F.avg("score"), F.lit(1.0)).alias("boundary_quality"),
    )
    return out.withColumn("overall_score", overall()).withColumn("suggestions", advice()).drop("spread")


def evaluate_documents(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``evaluate`` with a row for every doc_id of ``docs``: those without chunks have zeros and no advice."""
    found = docs.select("doc_id").distinct().join(evaluate(chunks), "doc_id", "left")
    empty = {f.name: F.lit(0) if f.name != "suggestions" else F.array().cast("array<string>") for f in found.schema if f.name != "doc_id"}
    return found.withColumns({k: F.coalesce(F.col(k), v) for k, v in empty.items()})


def overall() -> Column:
    return sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)) / sum(WEIGHTS.values())


def advice() -> Column:
    said = [
        F.when(F.col("avg_coherence") < 0.6, ADVICE["coherence"]), F.when(F.col("avg_completeness") < 0.7, ADVICE["completeness"]),
        F.when((F.col("length_balance") < 0.6) & (F.col("spread") > 3), ADVICE["balance"]), F.when(F.col("avg_semantic_density") < 0.4, ADVICE["density"]),
        F.when(F.col("boundary_quality") < 0.6, ADVICE["boundary"]), F.when(F.col("overall_score") < 0.5, ADVICE["poor"]).when(F.col("overall_score") > 0.8, ADVICE["good"]),
    ]
    return F.filter(F.array(*said), lambda x: x.isNotNull())


def statistics(chunks: DataFrame, *by: str) -> DataFrame:
    """Counts, lengths, tokens, scores and a histogram of lengths, for each group or all chunks."""
    size = F.length("content")
    between = lambda low, high: F.count_if((size >= low) & (size < high))
    cols = [
        F.count("*").alias("total_chunks"), F.avg(size).alias("avg_length"), F.min(size).alias("min_length"), F.max(size).alias("max_length"), F.stddev_pop(size).alias("std_length"),
        F.avg("token_count").alias("avg_tokens"), between(0, 500).alias("lt_500"), between(500, 1000).alias("lt_1000"), between(1000, 1500).alias("lt_1500"), F.count_if(size >= 1500).alias("ge_1500"),
    ]
    if "semantic_score" in chunks.columns:
        cols += [F.avg("semantic_score").alias("avg_score"), F.min("semantic_score").alias("min_score"), F.max("semantic_score").alias("max_score")]
    return chunks.groupBy(*by).agg(*cols).filter("total_chunks > 0")


def summary(chunks: DataFrame) -> DataFrame:
    """Per document what a response names: chunks, paragraphs, tables, images, kinds and the mean of tokens."""
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("total_chunks"), F.count_if(F.col("chunk_type").isin("text_content", "mixed_content")).alias("total_paragraphs"), F.count_if("has_table").alias("total_tables"),
        F.count_if("has_image").alias("total_images"), F.sort_array(F.collect_set("chunk_type")).alias("chunk_types"), F.avg("token_count").alias("average_chunk_size"),
    )


#: What a report calls its figures, and its other lines (fixed values).
REPORT = {"avg_coherence": "连贯性得分", "avg_completeness": "完整性得分", "length_balance": "长度平衡性", "avg_semantic_density": "语义密度", "boundary_quality": "边界质量", "overall_score": "综合得分"}
REPORT_LINES = {"title": "文本切片质量评估报告", "count": "切片数量: %d", "mean": "平均长度: %.1f 字符", "range": "长度范围: %d - %d 字符", "measures": "质量指标:", "advice": "优化建议:", "none": "当前切片质量良好，无需特殊优化。"}


def report(quality: DataFrame) -> DataFrame:
    """(doc_id, report): sizes, measures and numbered advice of ``evaluate``'s rows as text between rules."""
    say = {k: F.lit(v) for k, v in REPORT_LINES.items()}
    shown = lambda k, *c: F.format_string(REPORT_LINES[k], *c)
    rule, blank = F.lit("=" * 50), F.lit("")
    numbered = F.array_join(F.transform("suggestions", lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x)), "\n")
    lines = [rule, say["title"], rule, shown("count", "n_chunks"), shown("mean", "avg_length"), shown("range", "min_length", "max_length"), blank, say["measures"]]
    lines += [F.format_string(f"  {name}: %.3f", F.col(c)) for c, name in REPORT.items()]
    lines += [blank, F.when(F.size("suggestions") > 0, F.concat(say["advice"], F.lit("\n"), numbered)).otherwise(say["none"]), blank, rule]
    return quality.select("doc_id", F.concat_ws("\n", *lines).alias("report"))


def preview(chunks: DataFrame, n: int = 3, size: int = 200) -> DataFrame:
    return chunks.orderBy("doc_id", "chunk_id").limit(n).select("doc_id", "chunk_id", F.left("content", F.lit(size)).alias("preview"))
