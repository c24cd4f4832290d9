"""The queries of this subpackage and their SQL."""

from . import chat_format, decontaminate, line_dedup, lm_score, mixing, near_dedup, quality_rules, repair, secrets, substring_dedup, token_counts, toxicity, whitening

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_chat_format": chat_format.query,
    "op3_token_counts": token_counts.query,
    "op4_substring_dedup": substring_dedup.query,
    "op5_source_mixing": mixing.query,
    "op6_line_dedup": line_dedup.query,
    "op7_secret_scan": secrets.query,
    "op8_lm_score": lm_score.query,
    "op9_quality_rules": quality_rules.query,
    "op10_near_dedup": near_dedup.query,
    "op11_embedding_whitening": whitening.query,
    "op12_conversation_repair": repair.query,
    "op13_toxicity": toxicity.query,
}
ORACLE_SQL = {
    "op1_decontaminate": decontaminate.SQL,
    "op2_chat_format": chat_format.SQL,
    "op5_source_mixing": mixing.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op9_quality_rules": quality_rules.SQL,
    "op12_conversation_repair": repair.SQL,
}
