"""The thin contract queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, langid, line_dedup, lm_score, mixing, quality, simhash, substring_dedup, suffix_array


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_source_mixing": mixing.op1,
        "op2_decontamination": decontam.op2,
        "op3_line_dedup": line_dedup.op3,
        "op4_substring_dedup": substring_dedup.op4,
        "op5_chat_format": chat.op5,
        "op6_simhash_near_dedup": simhash.op6,
        "op7_language_id": langid.op7,
        "op8_suffix_array_dedup": suffix_array.op8,
        "op9_quality_rules": quality.op9,
        "op10_lm_scoring": lm_score.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": line_dedup.OP3_SQL,
        "op4_substring_dedup": substring_dedup.OP4_SQL,
        "op5_chat_format": chat.OP5_SQL,
        "op9_quality_rules": quality.OP9_SQL,
        "op10_lm_scoring": lm_score.OP10_SQL,
    }
