"""The queries of this subpackage and the SQL that must return the same rows, where SQL can."""

from changeweave.llm import chat, decontaminate, exact_dedup, language_id, mixing, near_dedup, pii, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_mixing": mixing.op2_mixing,
    "op3_url_filters": url_filter.op3_url_filters,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_chat_formatting": chat.op7_chat_formatting,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_pii": pii.op9_pii,
    "op10_minhash_near_dedup": near_dedup.op10_minhash_near_dedup,
}
ORACLES = {
    "op2_mixing": mixing.ORACLE,
    "op3_url_filters": url_filter.ORACLE,
    "op5_decontamination": decontaminate.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op7_chat_formatting": chat.ORACLE,
    "op8_substring_dedup": substring_dedup.ORACLE,
    "op10_minhash_near_dedup": near_dedup.ORACLE,
}
