"""Registers a module's queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.fixture import VIEW

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None, view: bool = True) -> Callable[[Query], Query]:
        """sql follows the view's common table expressions, so it may start with further ones after a comma."""

        def put(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracles[f.__name__] = (VIEW if view else "") + sql
            return f

        return put
