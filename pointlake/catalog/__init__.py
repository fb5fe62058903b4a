"""The registered queries and, where SQL can state them, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _modules() -> list:
    from pointlake.catalog import drift, formats, meshes, points, streams, surfaces

    return [drift, points, meshes, surfaces, streams, formats]


def queries() -> dict[str, Query]:
    """All queries of the core, by name."""
    return {name: q for module in _modules() for name, q in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL for those queries that SQL can state."""
    return {name: sql for module in _modules() for name, sql in module.SQL.items()}
