"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from . import (
    chat_format, conversation_repair, decontamination, filter_audit, flac, jaccard_join, license_scan, line_dedup, lm_score, mixing, pii,
    sharding, toxicity,
)

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_lm_score": lm_score.op2_lm_score,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_mixing": mixing.op7_mixing,
    "op8_pii": pii.op8_pii,
    "op9_flac": flac.op9_flac,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_sharding": sharding.op13_sharding,
}

ORACLES = {
    "op3_decontamination": decontamination.ORACLE,
    "op4_chat_format": chat_format.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op10_jaccard_join": jaccard_join.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_conversation_repair": conversation_repair.ORACLE,
    "op13_sharding": sharding.ORACLE,
}
