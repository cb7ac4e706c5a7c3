"""All registered queries of the core and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.plans import conversation, evaluation, evidence, expansion, memory, quality, retrieval

MODULES = (retrieval, conversation, evaluation, expansion, memory, evidence, quality)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
