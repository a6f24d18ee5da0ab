"""A register of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a function under ``name``; ``sql`` gives the same rows in DuckDB."""

        def add(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"{name} is registered already")
            self.queries[name] = f
            if sql is not None:
                self.oracle[name] = sql
            return f

        return add
