"""All queries of the engine by name, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from proofset.plans import analytics, matching, relational, textual

Query = Callable[[SparkSession, str], DataFrame]
_ALL = {**relational.QUERIES, **textual.QUERIES, **analytics.QUERIES, **matching.QUERIES}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
