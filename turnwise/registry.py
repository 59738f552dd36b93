"""Names of the operators' queries, each with its function and, where SQL can say it, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: Modules that register queries when they are imported.
MODULES = ("operators.metrics", "operators.relational", "operators.windows", "operators.intervals", "operators.graph", "operators.mutes", "operators.segments", "operators.feeds", "operators.evaluation", "functions.text", "functions.masking", "functions.readouts", "functions.vocabulary", "functions.phonetics", "functions.grounding", "functions.schedules", "functions.vectors", "functions.scalars", "plans.rules", "plans.phrases", "streaming.events", "sources.ingest", "sources.tail")


def register(name: str, sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def _load() -> None:
    for m in MODULES:
        import_module(f"turnwise.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["ag01_executive_metrics"](spark, sf_dir)
