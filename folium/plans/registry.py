"""Collects a plan module's queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable


class Registry(dict):
    """name -> (query, oracle SQL or None)."""

    def query(self, name: str, sql: str | None = None) -> Callable:
        def add(fn):
            self[name] = (fn, sql)
            return fn

        return add
