"""Registration of queries: each has a name, a Spark callable and, if SQL can express it, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable], Query]:
    """Register a function of a table reader: ``fn(t)`` with ``t("documents")`` a DataFrame."""

    def register(fn: Callable) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = run
        if sql:
            _SQL[name] = sql
        return run

    return register


def _load() -> None:
    from rostrum.plans import checks, days, extras, files, identity, intervals, more, readmodels, records, search, speech, stores, streams, subjects, tables, text, voices  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search: BM25 and vectors fused by reciprocal ranks."""
    return queries()["T7_hybrid_search"](spark, sf_dir)
