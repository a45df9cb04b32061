"""Frequent words and pairs of Chinese characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that don't count unless the caller names others.
STOP_EN = ["the", "a", "an", "and", "or", "of", "to", "in", "on", "at", "by", "for", "from", "with", "as", "is", "are", "was", "be", "been", "it", "its", "this", "that", "these", "those", "not", "but"]
STOP_ZH = ["因为", "所以", "但是", "如果", "虽然", "而且", "或者", "以及", "可以", "已经", "这个", "那个", "这些", "那些", "什么", "怎么", "它们", "他们", "她们", "我们", "你们"]


def key_phrases(docs: DataFrame, top_k: int = 10, language: str = "en", stop: list[str] | None = None) -> DataFrame:
    """(doc_id, phrase, n, rank): the most frequent words, or for ``zh`` pairs of characters, that aren't stop words; ties by first place.

    Counted within each row by sorting its words, without a shuffle: rows that repeat a doc_id are ranked each on its own,
    null texts and those without words give none.
    """
    stop = stop if stop is not None else STOP_ZH if language == "zh" else STOP_EN
    if language == "zh":
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - 1, F.lit(1))), lambda i: F.substring("text", i, F.lit(2)))
        found = F.filter(pairs, lambda p: p.rlike(r"^[\x{4e00}-\x{9fff}]{2}$") & ~p.isin(stop))
    else:
        found = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)")), lambda w: (F.length(w) > 1) & ~w.isin(stop))
    rows = docs.select("doc_id", F.sort_array(F.transform(found, lambda w, i: F.struct(w.alias("phrase"), i.alias("first")))).alias("sorted"))
    placed = F.transform("sorted", lambda x, i: F.struct(x["phrase"].alias("phrase"), x["first"].alias("first"), i.alias("start")))
    runs = F.filter(placed, lambda r: (r["start"] == 0) | (F.get("sorted", r["start"] - 1)["phrase"] != r["phrase"]))
    rows = rows.select("doc_id", F.size("sorted").alias("size"), runs.alias("runs"))
    ranked = F.transform("runs", lambda r, i: F.struct((r["start"] - F.coalesce(F.get("runs", i + 1)["start"], F.col("size"))).alias("minus"), r["first"].alias("first"), r["phrase"].alias("phrase")))
    best = rows.select("doc_id", F.posexplode(F.slice(F.sort_array(ranked), 1, top_k)).alias("pos", "best"))
    return best.select("doc_id", "best.phrase", (-F.col("best.minus")).cast("long").alias("n"), (F.col("pos") + 1).alias("rank"))
