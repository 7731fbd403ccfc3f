"""Queries of the engine's own operators over the test tables, with SQL twins where SQL can say it."""

from __future__ import annotations

from tessera.plans import catalog_counts, catalog_groups, catalog_intervals, catalog_models, catalog_projects

_MODULES = (catalog_counts, catalog_intervals, catalog_groups, catalog_models, catalog_projects)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
