"""The queries of this subpackage and, where SQL can express them, their equivalents."""

from __future__ import annotations

from . import decontamination, embedding_dedup, hmm, line_dedup, mixing, pii, quality, sharding, simhash, substring_dedup


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            decontamination.op1_decontamination,
            quality.op2_quality_classifier,
            line_dedup.op3_line_dedup,
            simhash.op4_simhash_near_dedup,
            mixing.op5_source_mixing,
            hmm.op6_lm_scoring,
            embedding_dedup.op7_embedding_near_dedup,
            sharding.op8_sharding,
            pii.op9_personal_data,
            substring_dedup.op10_substring_dedup,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontamination.OP1_SQL, "op3_line_dedup": line_dedup.OP3_SQL, "op7_embedding_near_dedup": embedding_dedup.OP7_SQL}
