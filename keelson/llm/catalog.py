"""Queries and SQL of this subpackage."""

from __future__ import annotations

from . import brown, decontaminate, divergence, embed_dedup, filter_audit, line_dedup, minhash, mixing, nearest, passages, quality, toxicity, warc

MODULES = (warc, minhash, quality, decontaminate, mixing, embed_dedup, toxicity, line_dedup, brown, passages, nearest, divergence, filter_audit)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
