"""Registry of named queries (Spark callables) and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracle import with_adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``; ``sql`` is
    the DuckDB twin (without the adapter CTEs)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_adapters(sql)
        return fn
    return deco


MODULES = ["q_search", "q_stats", "q_quality", "q_text", "q_working", "q_context", "q_stream",
           "q_lifecycle", "q_links", "q_io"]


def attach_sql(name: str, sql: str) -> None:
    """Give an already registered query its DuckDB twin."""
    if name not in QUERIES:
        raise KeyError(name)
    ORACLE[name] = with_adapters(sql)


def load_all() -> None:
    """Import the query modules (importing fills the registry)."""
    import importlib
    import pkgutil
    from pathlib import Path
    present = {m.name for m in pkgutil.iter_modules([str(Path(__file__).parent)])}
    for name in MODULES:
        if name in present:
            importlib.import_module(f"{__package__}.{name}")
