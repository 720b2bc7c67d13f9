"""A registry of named queries: name -> (query, SQL)."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Queries by name, each with the SQL that gives the same result where SQL can."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a function under its name."""

        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add

    def describe(self) -> list[dict]:
        """Name, purpose and arguments of each query, as tools announce themselves."""
        return [
            {"name": name, "description": (f.__doc__ or "").strip(), "arguments": {
                p.name: {"required": p.default is p.empty, **({} if p.default is p.empty else {"default": p.default})}
                for p in list(inspect.signature(f).parameters.values())[2:]}}
            for name, f in self.queries.items()
        ]

    def call(self, spark: SparkSession, d: str, name: str, **arguments) -> DataFrame:
        """Run a query by name. Unknown names and arguments, and missing ones, raise before anything runs."""
        if name not in self.queries:
            raise KeyError(f"no query {name}; there are {', '.join(sorted(self.queries))}")
        f = self.queries[name]
        inspect.signature(f).bind(spark, d, **arguments)
        return f(spark, d, **arguments)

    def expose(self, spark: SparkSession, d: str, prefix: str = "q_") -> list[str]:
        """Make each query a temporary view for SQL; returns the views' names. Views are plans, nothing runs until they are read,
        but for queries that stage intermediate tables."""
        names = []
        for name, f in self.queries.items():
            f(spark, d).createOrReplaceTempView(prefix + name)
            names.append(prefix + name)
        return names
