"""Queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = [
    "exact_dedup",
    "sentencepiece",
    "minhash",
    "preference",
    "brown",
    "topk",
    "quality",
    "toxicity",
    "url_filter",
    "mixing",
    "repair",
    "negatives",
    "packing",
]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the same result in DuckDB's dialect."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def all_queries() -> dict[str, Query]:
    for name in MODULES:
        import_module(f"quakelake.llm.{name}")
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    all_queries()
    return dict(ORACLES)
