"""All queries of this folder and their SQL twins."""

from __future__ import annotations

from tessera.llm import clusters, components, leakage, neighbours, percentiles, sentences, tokenizer, topn

_MODULES = (clusters, topn, neighbours, percentiles, components, tokenizer, sentences, leakage)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
