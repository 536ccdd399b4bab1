"""Queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from strandloom.llm import conversation_repair, decontamination, license_scan, line_dedup, mixing, near_dedup, quality_rules, secret_scan, spelling_variants, substring_dedup, token_shards, toxicity, url_filter


def queries():
    """Name to callable of (spark, sf_dir)."""
    return {
        "op1_near_dedup": near_dedup.op1_near_dedup,
        "op2_mixing": mixing.op2_mixing,
        "op3_decontamination": decontamination.op3_decontamination,
        "op4_secret_scan": secret_scan.op4_secret_scan,
        "op5_token_shards": token_shards.op5_token_shards,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_substring_dedup": substring_dedup.op7_substring_dedup,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_conversation_repair": conversation_repair.op11_conversation_repair,
        "op12_spelling_variants": spelling_variants.op12_spelling_variants,
        "op13_license_scan": license_scan.op13_license_scan,
    }


def oracle_sql():
    """Name to DuckDB SQL, where SQL can express the result."""
    return {
        "op1_near_dedup": near_dedup.ORACLE_SQL,
        "op2_mixing": mixing.ORACLE_SQL,
        "op3_decontamination": decontamination.ORACLE_SQL,
        "op4_secret_scan": secret_scan.ORACLE_SQL,
        "op6_quality_rules": quality_rules.ORACLE_SQL,
        "op7_substring_dedup": substring_dedup.ORACLE_SQL,
        "op8_line_dedup": line_dedup.ORACLE_SQL,
        "op9_url_filter": url_filter.ORACLE_SQL,
        "op11_conversation_repair": conversation_repair.ORACLE_SQL,
        "op12_spelling_variants": spelling_variants.ORACLE_SQL,
        "op13_license_scan": license_scan.ORACLE_SQL,
    }
