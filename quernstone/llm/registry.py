"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from quernstone.llm import avi, language_id, line_dedup, mixing, near_dedup, pieces, quality, suffix_dedup, token_counts, topk

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_media_columns": avi.op2_media_columns,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_sentencepiece_nbest": pieces.op4_sentencepiece_nbest,
    "op5_language_id": language_id.op5_language_id,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_exact_topk": topk.op7_exact_topk,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_near_dedup": near_dedup.op10_near_dedup,
}

ORACLES = {
    "op7_exact_topk": topk.OP7_SQL,
    "op8_line_dedup": line_dedup.OP8_SQL,
    "op9_mix_sources": mixing.OP9_SQL,
    "op10_near_dedup": near_dedup.OP10_SQL,
}
