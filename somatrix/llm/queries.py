"""The operators' queries over the driver's tables, and their SQL."""

from __future__ import annotations

from somatrix.llm import bpe, chat_format, decontaminate, exact_dedup, filter_audit, language_id, merkle, pii, quality, sharding, simhash, substring_dedup, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_pii": pii.op4_pii,
    "op5_sharding": sharding.op5_sharding,
    "op6_benchmark_decontamination": decontaminate.op6_benchmark_decontamination,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_quality": quality.op8_quality,
    "op9_language_id": language_id.op9_language_id,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_chat_formatting": chat_format.op11_chat_formatting,
    "op12_filter_interaction_audit": filter_audit.op12_filter_interaction_audit,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

SQL = {
    "op2_substring_dedup": substring_dedup.OP2_SQL,
    "op6_benchmark_decontamination": decontaminate.OP6_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op12_filter_interaction_audit": filter_audit.OP12_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
