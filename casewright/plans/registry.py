"""A registry of queries: a callable (spark, sf_dir) -> DataFrame and, where it exists, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add

    def sql_without(self, name: str, old: str, new: str = "") -> str:
        """The SQL of a query over a part of its input, with that limit taken out (or another one put in)."""
        sql = self.sql[name]
        if old not in sql:
            raise ValueError(f"the SQL of {name} does not hold {old!r}")
        return sql.replace(old, new)
