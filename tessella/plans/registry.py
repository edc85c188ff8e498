"""All queries of the core and the SQL that they are checked against."""
from __future__ import annotations

from tessella.plans import cases, histories, histories_sql, join_queries, line_queries, more_queries, report_queries, service_queries, stream_queries

_ALL = (histories, line_queries, join_queries, service_queries, report_queries, stream_queries, cases, more_queries)
QUERIES = {name: f for module in _ALL for name, f in module.QUERIES.items()}
ORACLE = {name: sql for module in (histories_sql, *_ALL[1:]) for name, sql in module.ORACLE.items()}
