"""All registered queries of the library's own operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False, **views: str) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame under its name. views are put before the SQL as CTEs."""
    head = "with recursive" if recursive else "with"

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            heads = ", ".join(f"{k} as ({v})" for k, v in views.items())
            ORACLES[f.__name__] = f"{head} {heads} {sql}" if heads else sql
        return f

    return add
