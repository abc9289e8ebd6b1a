"""Queries of the training-data operators and, where SQL can express one, their oracle."""

from __future__ import annotations

from octofold.llm import balanced_shards, conversation_repair, decontaminate, html_text, language_id, near_dups, phrase_stripes, pii_spans, quality_rules, secret_scan, spm_codec, token_count, vector_search

MODULES = [pii_spans, html_text, decontaminate, near_dups, language_id, token_count, secret_scan, quality_rules, balanced_shards, spm_codec, phrase_stripes, vector_search, conversation_repair]


def queries() -> dict:
    return {name: call for m in MODULES for name, call in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
