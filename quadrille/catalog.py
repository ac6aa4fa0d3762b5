"""The registry of the library's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .queries import boards, games, outcomes, shuffles, symmetry, tables

Query = Callable[[SparkSession, str], DataFrame]
_ALL = {**boards.QUERIES, **games.QUERIES, **outcomes.QUERIES, **shuffles.QUERIES, **symmetry.QUERIES, **tables.QUERIES}


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _ALL.items() if sql}
