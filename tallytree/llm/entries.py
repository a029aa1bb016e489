"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from tallytree.llm import chat_format, fingerprints, jaccard_join, lexical_search, line_dedup, manifest_oracles, merge_dropout, merkle_manifest, ngram_lm, oracles, packing, personal_data, quality_rules, substring_dedup, toxicity

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_pii": personal_data.op5_pii,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_ngram_jaccard_join": jaccard_join.op7_ngram_jaccard_join,
    "op8_lm_scoring": ngram_lm.op8_lm_scoring,
    "op9_packing": packing.op9_packing,
    "op10_merge_dropout": merge_dropout.op10_merge_dropout,
    "op11_merkle_manifest": merkle_manifest.op11_merkle_manifest,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_chat_format": chat_format.op13_chat_format,
}
ORACLES = {**oracles.ORACLES, **manifest_oracles.ORACLES}

__all__ = ["ORACLES", "QUERIES"]
