"""Registry of named queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str | None = None, doubles: tuple[str, ...] | list[str] = ()) -> Callable[[Query], Query]:
    """Register a query; its double columns are rounded to six places on both sides."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir).withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c in doubles})

        _queries[name] = run
        if sql:
            _oracles[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) + 0.0::DOUBLE AS {c}' for c in doubles)}) FROM ({sql})" if doubles else sql
        return fn

    return add


def _load() -> None:
    from panelforge.plans import aggregate_queries, function_queries, market_queries, series_queries, source_queries, study_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
