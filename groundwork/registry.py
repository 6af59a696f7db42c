"""Every query of the package with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]
_RUNS: dict[str, Run] = {}
_SQL: dict[str, str] = {}


def operator(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Registers run(spark, sf_dir) under name; sql is the same query for another engine."""

    def add(run: Run) -> Run:
        if name in _RUNS:
            raise ValueError(f"{name} is registered twice")
        _RUNS[name] = run
        if sql:
            _SQL[name] = sql
        return run

    return add


def queries() -> dict[str, Run]:
    return dict(_RUNS)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def load_all() -> None:
    """Imports the modules that register queries."""
    import importlib

    for name in MODULES:
        importlib.import_module(f"groundwork.{name}")


MODULES = ["operators.tables", "operators.keyed_table", "operators.retrieval", "operators.search_index", "operators.chronology", "operators.spatial", "operators.stratigraphy", "operators.graph", "operators.conflicts", "operators.gating", "operators.extraction", "sources.files", "streaming.jobs"]
