"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from flowmill.plans import file_queries, ml_queries, queries, stream_queries

QUERIES = queries.QUERIES | ml_queries.QUERIES | stream_queries.QUERIES | file_queries.QUERIES
SQL = queries.SQL | ml_queries.SQL | stream_queries.SQL | file_queries.SQL
