"""All queries of this package but the training-data ones, and their DuckDB counterparts."""

from __future__ import annotations

from pagewright.plans import box_queries, page_queries, pixel_queries, rule_queries, store_queries, text_queries, table_queries

_ALL = (store_queries, text_queries, box_queries, rule_queries, page_queries, table_queries, pixel_queries)
QUERIES = {name: f for module in _ALL for name, f in module.QUERIES.items()}
ORACLE = {name: sql for module in _ALL for name, sql in module.ORACLE.items()}
