"""Queries over the driver's tables by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

FLAGSHIP = "reshape_values"
QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


from . import composite, files, jobs, joins, labels, listings, maps, sets, shapes  # noqa: E402, F401  (they register themselves)
