"""The registered queries: operators bound to tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, and the DuckDB SQL that gives the same rows."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(query: Query) -> Query:
            self.queries[name] = query
            if sql:
                self.sql[name] = sql
            return query

        return keep


REGISTRY = Registry()


def load() -> Registry:
    """Import every module of queries once."""
    from leafloom.plans import compare, documents, entitlements, integrity, ordering, payments, rules, tables  # noqa: F401

    return REGISTRY
