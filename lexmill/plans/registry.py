"""Queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a function as a query; ``views`` are the common table expressions that its SQL starts from."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            head = ("WITH " + ",\n".join(views) + "\n") if views else ""
            SQL[f.__name__] = head + sql
        return f

    return add
