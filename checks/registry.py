"""Keeps queries and their comparison SQL side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)``; ``sql`` gives the same rows in DuckDB."""
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


def rnd(expression: str, digits: int) -> str:
    """Rounded SQL expression; adding zero turns a negative zero into zero."""
    return f"(round({expression}, {digits}) + 0.0)"


def with_ctes(ctes: dict[str, str], body: str, needs: str, recursive: bool = False) -> str:
    """``body`` preceded by the chain of CTEs up to and including ``needs``."""
    chain = []
    for name, text in ctes.items():
        chain.append(f"{name} AS ({text})")
        if name == needs:
            break
    else:
        raise KeyError(needs)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(chain) + "\n" + body
