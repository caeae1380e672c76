"""The training-data queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from sessionloom.llm import conversations, decontamination, jaccard_join, packing, quality_compression, quality_rules, secrets, sharding, suffix_dedup, token_alignment, token_counts, url_filters, warc

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_packing": packing.op2_packing,
    "op3_secret_scans": secrets.op3_secret_scans,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_ngram_jaccard": jaccard_join.op6_ngram_jaccard,
    "op7_sharding": sharding.op7_sharding,
    "op8_url_filters": url_filters.op8_url_filters,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_quality_classifier": quality_compression.op10_quality_classifier,
    "op11_token_alignment": token_alignment.op11_token_alignment,
    "op12_warc": warc.op12_warc,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}

ORACLES = {
    "op1_decontamination": decontamination.OP1_SQL,
    "op5_suffix_dedup": suffix_dedup.OP5_SQL,
    "op6_ngram_jaccard": jaccard_join.OP6_SQL,
    "op12_warc": warc.OP12_SQL,
    "op13_conversation_repair": conversations.OP13_SQL,
}
