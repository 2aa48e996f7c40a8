"""Every registered query over the driver's tables, with the DuckDB SQL it equals."""

from __future__ import annotations

from corpuscle import queries as registry
from corpuscle.queries import Query
from corpuscle.queries import architecture, graph, journal, metadata, relations, search, structure  # noqa: F401  they register themselves


def queries() -> dict[str, Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
