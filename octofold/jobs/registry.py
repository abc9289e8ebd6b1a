"""All registered queries of the library outside ``llm``."""

from __future__ import annotations

from octofold.jobs import file_queries, fusion_queries, map_queries, series_queries, space_queries, stream_queries

MODULES = [map_queries, space_queries, series_queries, fusion_queries, stream_queries, file_queries]


def queries() -> dict:
    return {name: call for m in MODULES for name, call in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
