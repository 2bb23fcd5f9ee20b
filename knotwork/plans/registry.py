"""Registered queries of the knowledge operators and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from knotwork.plans import graph_queries, text_queries

MODULES = (graph_queries, text_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in MODULES for name, (f, _) in module.FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.FOUND.items() if sql is not None}
