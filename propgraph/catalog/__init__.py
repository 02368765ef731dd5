"""Every query of the graph engine by name, with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from propgraph.catalog.registry import ORACLES, QUERIES

from propgraph.catalog import algorithms, basic, languages, statistics, tools  # noqa: E402,F401  (they register)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
