"""The engine's own queries and their SQL, by name."""

from __future__ import annotations

from . import graph_queries, growth_queries, item_queries, job_queries, listing_queries, membership_queries, search_queries, text_queries

_MODULES = (growth_queries, item_queries, search_queries, membership_queries, text_queries, graph_queries, job_queries, listing_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
