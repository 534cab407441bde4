"""All queries on whole tables and their SQL."""

from __future__ import annotations

from cohortry.plans import estimate_queries, path_queries, sales_queries, scenario_queries, share_queries, source_queries

_ALL = {**sales_queries.QUERIES, **share_queries.QUERIES, **path_queries.QUERIES, **estimate_queries.QUERIES, **scenario_queries.QUERIES, **source_queries.QUERIES}
QUERIES = {name: f for name, (f, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
flagship = sales_queries.widget_sales
