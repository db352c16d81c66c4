"""Queries of the subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillwork.llm import alignment, bpe, exact_dedup, filter_audit, html_text, mixing, near_dedup, packing, pii, quality_rules, sharding, toxicity, url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": html_text.op1_html_text,
        "op2_bpe": bpe.op2_bpe,
        "op3_packing": packing.op3_packing,
        "op4_near_dedup": near_dedup.op4_near_dedup,
        "op5_sharding": sharding.op5_sharding,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_pii": pii.op9_pii,
        "op10_url_filters": url_filters.op10_url_filters,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_mixing": mixing.op12_mixing,
        "op13_alignment": alignment.op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_sharding": sharding.SQL,
        "op6_quality_rules": quality_rules.SQL,
        "op7_exact_dedup": exact_dedup.SQL,
        "op10_url_filters": url_filters.SQL,
        "op11_filter_audit": filter_audit.SQL,
        "op12_mixing": mixing.SQL,
    }
