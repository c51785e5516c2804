"""Registered queries: a Spark builder and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.builders: dict[str, Builder] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
        def put(fn: Builder) -> Builder:
            if name in self.builders:
                raise ValueError(f"query {name} registered twice")
            self.builders[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return put
