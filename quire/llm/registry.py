"""The queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import counting, decontamination, fim, html_text, jaccard, negatives, packing, quality, secrets, sharding, token_files, topk, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_urls": urls.op1,
        "op2_token_files": token_files.op2,
        "op3_packing": packing.op3,
        "op4_html": html_text.op4,
        "op5_quality": quality.op5,
        "op6_decontamination": decontamination.op6,
        "op7_jaccard": jaccard.op7,
        "op8_token_counts": counting.op8,
        "op9_secrets": secrets.op9,
        "op10_sharding": sharding.op10,
        "op11_fim": fim.op11,
        "op12_topk": topk.op12,
        "op13_negatives": negatives.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_quality": quality.OP5_SQL,
        "op7_jaccard": jaccard.OP7_SQL,
        "op9_secrets": secrets.OP9_SQL,
        "op10_sharding": sharding.OP10_SQL,
        "op11_fim": fim.OP11_SQL,
        "op12_topk": topk.OP12_SQL,
        "op13_negatives": negatives.OP13_SQL,
    }
