"""A corpus from quality filter to token ids; each stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import line_dedup, mixing, near_dedup, pieces, quality
from quernstone.llm.common import discard, table, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores under 0.5 go; null texts are scored as empty ones, repeated rows alike.
    Without labels all stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites stay in one document; rows and null texts stay, n_chars follows the text."""
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, and one of rows that repeat doc_id and text; texts without words
    and rows without doc_id stay."""
    return near_dedup.drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated as their sources' targets ask, rows of a null source as those of one more source; texts
    without words are kept by their source's rate like others."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: doc_id, lang, source, pieces of the best segmentation, scores of the best few, the library's own ids, and
    the text that the pieces decode to. A null or empty text has no pieces and decodes to an empty one."""
    return pieces.encode(docs, ["doc_id", "lang", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_filter),
    ("line dedup", boilerplate_lines),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", token_ids),
]

#: The classifier can't be written as SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's table goes when the next one's is written. An empty table gives an empty one."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1], 1):
        last, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{k}")
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
