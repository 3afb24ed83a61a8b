"""Queries of the core operators over whole tables, each with SQL for the same rows where SQL can express them."""

from siltstone.plans import detector_queries, group_queries, metric_queries, text_queries

_MODULES = (text_queries, metric_queries, group_queries, detector_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
