"""The queries of this package, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from . import media, mixing, neardup, outliers, personal, pieces, quality, substrings, suffixes, tokens

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_token_counts": tokens.op3_token_counts,
    "op4_quality_rules": outliers.op4_quality_rules,
    "op5_media_columns": media.op5_media_columns,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_near_dedup": neardup.op8_near_dedup,
    "op9_personal_data": personal.op9_personal_data,
    "op10_substring_dedup": substrings.op10_substring_dedup,
}

SQL = {"op1_mixing": mixing.OP1_SQL}
