"""All queries of the library proper, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import document_queries, graph_queries, node_queries, page_queries, scene_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**node_queries.QUERIES, **page_queries.QUERIES, **graph_queries.QUERIES, **document_queries.QUERIES, **scene_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**node_queries.ORACLE_SQL, **page_queries.ORACLE_SQL, **graph_queries.ORACLE_SQL, **document_queries.ORACLE_SQL, **scene_queries.ORACLE_SQL}
