"""Registry that pairs each query with its check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, key: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            if key in self.queries:
                raise ValueError(f"query {key} registered twice")
            self.queries[key] = fn
            if sql is not None:
                self.oracles[key] = sql
            return fn

        return register
