"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import exact_dedup, importance, language_id, line_dedup, lm_score, mixing, ngram_join, packing, pii, spotsigs

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_lm_score": lm_score.op2_lm_score,
    "op3_spotsigs": spotsigs.op3_spotsigs,
    "op4_source_mixing": mixing.op4_source_mixing,
    "op5_pattern_packing": packing.op5_pattern_packing,
    "op6_importance_resampling": importance.op6_importance_resampling,
    "op7_language_id": language_id.op7_language_id,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_pii": pii.op9_pii,
    "op10_ngram_jaccard_join": ngram_join.op10_ngram_jaccard_join,
}

SQL = {
    "op1_line_dedup": line_dedup.SQL,
    "op4_source_mixing": mixing.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op10_ngram_jaccard_join": ngram_join.SQL,
}
