"""Named queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from riskframe.llm import ann, chat, exact, fim, mixing, neardup, ngram_join, packing, pii, repair, secret_models, toxicity, url_rules

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_prefix_forest": ann.op2_prefix_forest,
    "op3_url_rules": url_rules.op3_url_rules,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_personal_data": pii.op5_personal_data,
    "op6_secret_scan": secret_models.op6_secret_scan,
    "op7_source_mixing": mixing.op7_source_mixing,
    "op8_exact_dedup": exact.op8_exact_dedup,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_minhash_dedup": neardup.op10_minhash_dedup,
    "op11_fim_transform": fim.op11_fim_transform,
    "op12_ngram_join": ngram_join.op12_ngram_join,
    "op13_structure_repair": repair.op13_structure_repair,
}
ORACLE_SQL = {
    "op1_chat_format": chat.OP1_SQL,
    "op7_source_mixing": mixing.OP7_SQL,
    "op8_exact_dedup": exact.OP8_SQL,
    "op10_minhash_dedup": neardup.OP10_SQL,
    "op11_fim_transform": fim.OP11_SQL,
    "op12_ngram_join": ngram_join.OP12_SQL,
}
