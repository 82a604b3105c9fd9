"""The queries opN_<name> and the pipeline, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import chat, decontaminate, lm, mixing, near_dup, quality, sharding, token_files, topk, toxicity


def queries() -> dict:
    return {
        "op1_topk": topk.op1,
        "op2_toxicity": toxicity.op2,
        "op3_quality": quality.op3,
        "op4_chat_format": chat.op4,
        "op5_token_files": token_files.op5,
        "op6_sharding": sharding.op6,
        "op7_near_duplicates": near_dup.op7,
        "op8_decontamination": decontaminate.op8,
        "op9_lm": lm.op9,
        "op10_mixing": mixing.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": topk.ORACLE, "op7_near_duplicates": near_dup.ORACLE, "op8_decontamination": decontaminate.ORACLE}
