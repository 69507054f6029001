"""Every registered query of the forecasting operators, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _modules() -> tuple:
    from quakelode.plans import catalog, cells, events, learning, measurements

    return catalog, cells, events, learning, measurements


def queries() -> dict[str, Query]:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.SQL.items()}
