"""Where the query modules put their queries and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL if there is any."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from kinloom.plans import q_graph, q_paths, q_report, q_tables, q_vectors  # noqa: F401

    return dict(QUERIES), dict(ORACLES)
