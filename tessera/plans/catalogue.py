"""All registered queries with their DuckDB SQL, gathered from the modules of this package."""

from __future__ import annotations

from tessera.plans import extra_queries, language_queries, more_queries, moving_queries, relational, scalar_queries, source_queries, spatial_queries, stream_queries

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for module in (extra_queries, language_queries, more_queries, moving_queries, relational, scalar_queries, source_queries, spatial_queries, stream_queries):
    QUERIES.update(module.QUERIES)
    ORACLE_SQL.update(module.ORACLE_SQL)
