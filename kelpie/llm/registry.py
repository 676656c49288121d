"""Queries of the training-data operators."""

from __future__ import annotations

from kelpie.llm import alignment, audio, decontaminate, language_model, merkle, ngram_join, packing, pii, quality, repeats, sharding, token_files, toxicity

_MODULES = [alignment, audio, decontaminate, language_model, merkle, ngram_join, packing, pii, quality, repeats, sharding, token_files, toxicity]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.ORACLE.items()}
