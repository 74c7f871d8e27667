"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from . import decontaminate, exact_dedup, language_id, lm_scoring, mixing, quality, simhash, suffix_dedup, token_output, url_filter


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_simhash": simhash.op2_simhash,
        "op3_lm_scoring": lm_scoring.op3_lm_scoring,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_language_id": language_id.op5_language_id,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_mixing": mixing.op7_mixing,
        "op8_token_output": token_output.op8_token_output,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_quality": quality.op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontaminate": decontaminate.OP4_SQL,
        "op6_url_filter": url_filter.op6_sql(),
        "op7_mixing": mixing.OP7_SQL,
        "op9_exact_dedup": exact_dedup.OP9_SQL,
    }
