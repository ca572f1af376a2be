"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from paramloom.llm import (
    exact_dedup,
    line_dedup,
    mixing,
    near_dedup,
    packing,
    pii,
    quality,
    sharding,
    token_counts,
    url_filter,
)

QUERIES = {
    "op1_patterns_checksums": pii.op1_patterns_checksums,
    "op2_block_naming": exact_dedup.op2_block_naming,
    "op3_redirect_components": url_filter.op3_redirect_components,
    "op4_digest_cache": token_counts.op4_digest_cache,
    "op5_raking": mixing.op5_raking,
    "op6_hilbert": sharding.op6_hilbert,
    "op7_configuration_lp": packing.op7_configuration_lp,
    "op8_weak_supervision": quality.op8_weak_supervision,
    "op9_bottom_k": near_dedup.op9_bottom_k,
    "op10_unit_hashing": line_dedup.op10_unit_hashing,
}
#: Patterns with checksums (1), tokenizers (4, 7) and the curve (6) have none: their tests compare with brute force.
ORACLE_SQL = {
    "op2_block_naming": exact_dedup.ORACLE_SQL,
    "op3_redirect_components": url_filter.ORACLE_SQL,
    "op5_raking": mixing.ORACLE_SQL,
    "op8_weak_supervision": quality.ORACLE_SQL,
    "op9_bottom_k": near_dedup.ORACLE_SQL,
    "op10_unit_hashing": line_dedup.ORACLE_SQL,
}
