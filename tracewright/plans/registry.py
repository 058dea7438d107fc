"""name -> (query over Views, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tracewright.plans.adapters import Views

FOUND: dict[str, tuple[Callable[[Views], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register a query over whole tables."""

    def add(f: Callable[[Views], DataFrame]):
        FOUND[name] = (f, sql)
        return f

    return add
