"""Registered queries of the core and their SQL."""

from __future__ import annotations

from quillspan.plans import corpus_queries, hierarchy_queries, host_queries, search_queries, text_queries

_MODULES = [hierarchy_queries, text_queries, corpus_queries, search_queries, host_queries]

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
