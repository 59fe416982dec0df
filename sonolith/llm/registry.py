"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from . import decontamination, filter_audit, hard_negatives, language_id, lm_scoring, near_dedup, piece_codec, quality_classifier, quality_rules, sharding, token_output, toxicity, url_filters

MODULES = [toxicity, language_id, sharding, token_output, quality_rules, piece_codec, url_filters, near_dedup, decontamination, quality_classifier, lm_scoring, filter_audit, hard_negatives]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
