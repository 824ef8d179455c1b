"""Registry of named queries: each binds an operator to the fixture views and
carries the DuckDB oracle text (or none, for rows-only checks)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cargolake.sources.fixtures import with_views
from cargolake.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    oracle: str | None  # SQL over the fixture views; CTEs are added on export


REGISTRY: dict[str, Query] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, oracle)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the modules registers their queries
    from cargolake.plans import queries_core, queries_quality, queries_writes, queries_history, queries_streams, queries_metrics_text, queries_streaming, queries_families, queries_workers, queries_indexes  # noqa: F401
    return REGISTRY


def spark_callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {}
    for name, q in load_all().items():
        out[name] = (lambda build: (lambda spark, sf_dir: build(Tables(spark, sf_dir))))(q.build)
    return out


def oracle_sqls() -> dict[str, str]:
    return {name: with_views(q.oracle, "duckdb") for name, q in load_all().items() if q.oracle}
