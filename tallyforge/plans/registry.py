"""Queries by name: what each runs, the operators that it covers, and its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..adapters import Tables, oracle


@dataclass
class Query:
    run: Callable[[Tables], DataFrame]
    ops: str
    sql: str | None


REGISTERED: dict[str, Query] = {}


def query(ops: str, sql: str | None = None) -> Callable:
    """Registers a function of Tables under its name. ops: the ids of the operators that it covers."""

    def put(run: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        REGISTERED[run.__name__] = Query(run, ops, sql)
        return run

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, q=q: q.run(Tables(spark, sf_dir))) for name, q in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle(q.sql) for name, q in REGISTERED.items() if q.sql}
