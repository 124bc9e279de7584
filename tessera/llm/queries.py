"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from tessera.llm import query_chat, query_decontaminate, query_jaccard, query_mixing, query_models, query_repeats, query_secrets, query_spotsigs

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for module in (query_chat, query_decontaminate, query_jaccard, query_mixing, query_models, query_repeats, query_secrets, query_spotsigs):
    QUERIES.update(module.R.queries)
    ORACLE_SQL.update(module.R.sql)
