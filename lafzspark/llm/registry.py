"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from lafzspark.llm import chat, decontaminate, mixing, mtree, private_data, quality, shingle_join, substring_dedup, token_counts, toxicity

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1,
    "op2_toxicity": toxicity.op2,
    "op3_decontaminate": decontaminate.op3,
    "op4_mix_sources": mixing.op4,
    "op5_exact_top_k": mtree.op5,
    "op6_token_counts": token_counts.op6,
    "op7_jaccard_join": shingle_join.op7,
    "op8_chat_examples": chat.op8,
    "op9_private_data": private_data.op9,
    "op10_quality": quality.op10,
}
ORACLE_SQL = {
    "op1_substring_dedup": substring_dedup.OP1_SQL,
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op5_exact_top_k": mtree.OP5_SQL,
    "op7_jaccard_join": shingle_join.OP7_SQL,
    "op8_chat_examples": chat.OP8_SQL,
}
