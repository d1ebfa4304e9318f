"""Queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

import importlib

MODULES = ("decontaminate", "mixing", "ngram_join", "line_dedup", "quality", "suffix_dedup", "language_model", "chat", "embeddings", "warc", "hard_negatives", "lexical_search", "language_id")


def _loaded():
    return [importlib.import_module(f"tallyward.llm.{m}") for m in MODULES]


def queries() -> dict:
    return {k: f for m in _loaded() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _loaded() for k, s in m.SQL.items()}
