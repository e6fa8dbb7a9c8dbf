"""All queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paylens.workloads import aggregates, cleaning, extraction, facets, geo, joins, refreshing, series

_MODULES = (cleaning, joins, series, aggregates, facets, geo, extraction, refreshing)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for m in _MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
