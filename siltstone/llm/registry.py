"""The queries of the training-data operators, and SQL for those that SQL can express."""

from siltstone.llm import html_extraction, language_id, license_scan, line_dedup, packing, quality_classifier, quality_rules, simhash, suffix_pieces, topk_search

_MODULES = (quality_rules, packing, language_id, line_dedup, simhash, topk_search, html_extraction, license_scan, quality_classifier, suffix_pieces)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
