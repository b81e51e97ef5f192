"""Queries of this package and the SQL they are compared with."""

from __future__ import annotations

from faultline.llm import (
    decontamination, hard_negatives, html_extraction, language_id, lm_scoring, max_sketches, near_dedup, packing,
    perplexity_rules, quality_classifier, secret_scan, substring_dedup, warc_store)

QUERIES = {
    "op1_lm_scoring": lm_scoring.op1_lm_scoring,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_warc": warc_store.op4_warc,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_language_id": language_id.op6_language_id,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_html_extraction": html_extraction.op8_html_extraction,
    "op9_packing": packing.op9_packing,
    "op10_quality_rules": perplexity_rules.op10_quality_rules,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_lexical_search": max_sketches.op12_lexical_search,
    "op13_secret_scan": secret_scan.op13_secret_scan,
}
ORACLES = {
    "op1_lm_scoring": lm_scoring.OP1_SQL,
    "op2_decontamination": decontamination.OP2_SQL,
    "op3_near_dedup": near_dedup.OP3_SQL,
    "op4_warc": warc_store.OP4_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op12_lexical_search": max_sketches.OP12_SQL,
}
