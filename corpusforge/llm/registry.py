"""Queries of this subpackage: name -> callable, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "q_mixing", "q_ngram_join", "q_html_text", "q_license_scan", "q_language_id", "q_quote_links", "q_url_filter", "q_quality", "q_suffix_dedup",
    "q_decontaminate", "q_sharding", "q_whitening", "q_prefix_trie",
]


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"corpusforge.llm.{name}"), attribute)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE")
