"""The package's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from waypath.llm import decontaminate, filter_audit, manifest, mixing, oracle, pii, quality, secret_scan, simhash, substring_dedup, tokens, toxicity

QUERIES = {
    "op1_token_counts": tokens.op1,
    "op2_mixing": mixing.op2,
    "op3_personal_data": pii.op3,
    "op4_token_shards": tokens.op4,
    "op5_toxicity": toxicity.op5,
    "op6_suffix_dedup": substring_dedup.op6,
    "op7_quality": quality.op7,
    "op8_simhash_dedup": simhash.op8,
    "op9_substring_dedup": substring_dedup.op9,
    "op10_decontamination": decontaminate.op10,
    "op11_filter_audit": filter_audit.op11,
    "op12_merkle_manifest": manifest.op12,
    "op13_secrets": secret_scan.op13,
}

ORACLE_SQL = {
    "op2_mixing": oracle.MIXING,
    "op6_suffix_dedup": oracle.BYTES,
    "op9_substring_dedup": oracle.REPEATED_WORDS,
    "op10_decontamination": oracle.CONTAMINATION,
    "op11_filter_audit": oracle.FILTERS,
    "op12_merkle_manifest": oracle.MANIFEST,
}
