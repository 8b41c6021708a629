"""Registered queries: each over whole tables, with the SQL that must agree with it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def register(body: Query) -> Query:
        QUERIES[body.__name__] = body
        if sql is not None:
            ORACLES[body.__name__] = sql
        return body

    return register


from . import arrays, graphs, numeric, placement, sorting, streams  # noqa: E402, F401
