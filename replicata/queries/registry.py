"""Registration of queries beside their oracle."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self._queries: dict[str, Callable] = {}
        self._sql: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            key = name or f.__name__
            if key in self._queries:
                raise ValueError(f"query {key} is registered twice")
            self._queries[key] = f
            if sql:
                self._sql[key] = sql
            return f

        return add

    def queries(self) -> dict[str, Callable]:
        return dict(self._queries)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self._sql)
