"""The queries of this subpackage and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

from . import decontaminate, html_extract, jaccard_join, quality_rules, sharding, sp_encode, suffix_dedup, token_files, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_sentencepiece": sp_encode.query,
        "op2_html_extraction": html_extract.query,
        "op3_suffix_array_dedup": suffix_dedup.query,
        "op4_url_filter": url_filter.query,
        "op5_toxicity": toxicity.query,
        "op6_token_files": token_files.query,
        "op7_decontamination": decontaminate.query,
        "op8_quality_rules": quality_rules.query,
        "op9_sharding": sharding.query,
        "op10_jaccard_join": jaccard_join.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": url_filter.sql(), "op7_decontamination": decontaminate.sql(), "op10_jaccard_join": jaccard_join.sql()}
