"""All queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from tracewright.llm import byte_bpe, chroma, language, merkle, mixing, near_duplicates, pieces, prefix_trie, pseudonyms, quality, token_files, top_k, url_filter

MODULES = (url_filter, mixing, language, quality, near_duplicates, top_k, pseudonyms, token_files, byte_bpe, chroma, pieces, merkle, prefix_trie)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
