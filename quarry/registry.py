"""All queries of the library outside the training-data subpackage."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from quarry.session import ship_code

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
    """Register a query (spark, sf_dir) -> DataFrame and its DuckDB SQL."""

    def add(function: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        @wraps(function)
        def run(spark, sf_dir):
            ship_code(spark)
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return add


def load() -> None:
    from quarry.plans import columns, entities, files, graph, outputs, plugs, relational, search, spans, streams, texts  # noqa: F401
