"""The queries of the subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from tremorframe.llm import (
    bigram_trie,
    chat,
    language,
    mixing,
    multi_index,
    near_copies,
    pieces,
    quality,
    shards,
    spelling,
    url_rules,
    vector_groups,
    whitening,
)

_MODULES = (
    pieces, multi_index, vector_groups, near_copies, mixing, chat, language, quality, url_rules, bigram_trie,
    shards, whitening, spelling,
)

QUERIES = {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in getattr(module, "ORACLES", {}).items()}
