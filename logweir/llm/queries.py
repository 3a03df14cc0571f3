"""The training-data queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from logweir.llm import chat, lines, mixing, neighbours, packing, pii, quality, scoring, sharding, simhash

QUERIES = {
    "op1_projection_forest": neighbours.op1_projection_forest,
    "op2_source_mixing": mixing.op2_source_mixing,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_simhash": simhash.op4_simhash,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_masked_pseudo_likelihood": scoring.op6_masked_pseudo_likelihood,
    "op7_hash_tree_sharding": sharding.op7_hash_tree_sharding,
    "op8_pii_surrogates": pii.op8_pii_surrogates,
    "op9_sum_of_squares_packing": packing.op9_sum_of_squares_packing,
    "op10_chat_formatting": chat.op10_chat_formatting,
}
ORACLES = {
    "op2_source_mixing": mixing.plan_sql(),
    "op3_quality_rules": quality.quality_sql(),
    "op5_line_dedup": lines.lines_sql(),
    "op10_chat_formatting": chat.CHAT_SQL,
}
