"""Registered queries of the package and their DuckDB statements."""

from __future__ import annotations

from . import bpe, conversation_repair, decontaminate, html_text, language_mixture, ngram_join, periodic_runs, pii, quality_model, quality_rules, secret_scan, suffix_dedup, token_counts

QUERIES = {
    "op1_quality": quality_model.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_ngram_join": ngram_join.query,
    "op4_bpe": bpe.query,
    "op5_token_counts": token_counts.query,
    "op6_pii": pii.query,
    "op7_quality_rules": quality_rules.query,
    "op8_secrets": secret_scan.query,
    "op9_decontaminate": decontaminate.query,
    "op10_html_text": html_text.query,
    "op11_language_mixture": language_mixture.query,
    "op12_conversation_repair": conversation_repair.query,
    "op13_periodic_runs": periodic_runs.query,
}
ORACLES = {
    "op7_quality_rules": quality_rules.oracle_sql(),
    "op12_conversation_repair": conversation_repair.oracle_sql(),
}
