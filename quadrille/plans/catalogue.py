"""Every query of the library with the SQL that an independent engine answers it by."""

from __future__ import annotations

from quadrille.plans import data_queries, graph_queries, write_queries

QUERIES: dict = graph_queries.QUERIES | data_queries.QUERIES | write_queries.QUERIES
SQL: dict = graph_queries.SQL | data_queries.SQL | write_queries.SQL
