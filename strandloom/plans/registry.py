"""All registered queries of the sequence graph, and their DuckDB SQL."""

from __future__ import annotations

from strandloom.plans import event_queries, file_queries, oracle, path_queries, queries

QUERIES = queries.QUERIES | file_queries.QUERIES | event_queries.QUERIES | path_queries.QUERIES
ORACLE = oracle.ORACLE | file_queries.ORACLE | event_queries.ORACLE | path_queries.ORACLE
