"""Queries of this package and their SQL."""

from __future__ import annotations

from shelfmate.llm import (
    bpe,
    conversation_repair,
    exact_dedup,
    html_wrappers,
    log_bilinear,
    mixing,
    near_dedup,
    quality_net,
    quality_rules,
    secret_ledger,
    spelling,
    url_filters,
    warc,
)

QUERIES = {
    "op1_near_dedup": near_dedup.query,
    "op2_quality_net": quality_net.query,
    "op3_byte_bpe": bpe.query,
    "op4_url_filters": url_filters.query,
    "op5_warc_roundtrip": warc.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_quality_rules": quality_rules.query,
    "op8_log_bilinear": log_bilinear.query,
    "op9_html_wrappers": html_wrappers.query,
    "op10_mix_sources": mixing.query,
    "op11_spelling_permuterm": spelling.query,
    "op12_secret_ledger": secret_ledger.query,
    "op13_conversation_repair": conversation_repair.query,
}

ORACLES = {
    "op4_url_filters": url_filters.ORACLE,
    "op5_warc_roundtrip": warc.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op7_quality_rules": quality_rules.ORACLE,
    "op11_spelling_permuterm": spelling.ORACLE,
    "op12_secret_ledger": secret_ledger.ORACLE,
}
