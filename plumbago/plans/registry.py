"""Registered queries with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbago.plans import annotation_queries, corpus_queries, detail_queries, geometry_queries, mixing_queries, scoring

MODULES = (scoring, geometry_queries, annotation_queries, corpus_queries, mixing_queries, detail_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
