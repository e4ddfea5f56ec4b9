"""Queries of the corpus operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import byte_bpe, embed_dedup, jaccard_join, nearest, packing, pii, quality, suffix_dedup, token_files, url_filter

QUERIES = {
    "op1_jaccard_join": jaccard_join.op1_jaccard_join,
    "op2_token_files": token_files.op2_token_files,
    "op3_quality": quality.op3_quality,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_byte_bpe": byte_bpe.op5_byte_bpe,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_packing": packing.op7_packing,
    "op8_nearest": nearest.op8_nearest,
    "op9_pii": pii.op9_pii,
    "op10_embed_dedup": embed_dedup.op10_embed_dedup,
}
ORACLES = {"op6_url_filter": url_filter.ORACLE}
