"""Collects the queries and oracles that the operator modules register."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, build: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    _QUERIES[name] = build
    if oracle is not None:
        _ORACLES[name] = oracle


def _load() -> None:
    from .plans import all_queries  # noqa: F401  importing registers


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLES
