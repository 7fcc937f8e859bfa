"""Registry of every query the repository exposes, each with its DuckDB oracle.

``QUERIES[name] = (spark_fn(spark, sf_dir) -> DataFrame, oracle_sql or None)``.
Every query reads the driver's tables (or data Spark derives from them) in full.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, tuple[Callable, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict[str, tuple[Callable, str | None]]:
    # Import side effects fill QUERIES.
    from penprint.plans import queries_collect, queries_core, queries_features, queries_ml, queries_prompting, queries_scoring, queries_sinks, queries_streaming  # noqa: F401
    return QUERIES
