"""The registered queries of the corpus operators, and their SQL where SQL can say it."""

from . import chat_tree, conversation_repair, decontamination, exact_dedup, lm_scoring, ngram_join, packing, pii, quality, secret_scan, sharding, substring_dedup, token_alignment

QUERIES = {
    "op1_shard": sharding.op1_shard,
    "op2_secrets": secret_scan.op2_secrets,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_quality": quality.op5_quality,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_decontaminate": decontamination.op7_decontaminate,
    "op8_lm_score": lm_scoring.op8_lm_score,
    "op9_pii": pii.op9_pii,
    "op10_pack": packing.op10_pack,
    "op11_format": chat_tree.op11_format,
    "op12_align": token_alignment.op12_align,
    "op13_repair": conversation_repair.op13_repair,
}
ORACLES = {
    "op1_shard": sharding.ORACLE,
    "op2_secrets": secret_scan.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op4_substring_dedup": substring_dedup.ORACLE,
    "op7_decontaminate": decontamination.ORACLE,
}
