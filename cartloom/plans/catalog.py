"""Registry of runnable queries and the SQL that checks each of them.

A query is a function of a :class:`~cartloom.plans.mart.Mart`.  Its check SQL
may name any view of ``cartloom.plans.check_views``; the views it uses,
directly or through others, are prepended as common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cartloom.plans.check_views import VIEWS
from cartloom.plans.mart import Mart, mart_for

QUERIES: dict[str, Callable[[Mart], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a query, with its check SQL unless it is model- or seed-dependent."""

    def register(fn: Callable[[Mart], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"{key} registered twice")
        QUERIES[key] = fn
        if sql is not None:
            CHECKS[key] = sql
        return fn

    return register


def runnable(key: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return QUERIES[key](mart_for(spark, sf_dir))

    run.__name__ = key
    return run


def _needed(body: str, seen: list[str], above: tuple[str, ...] = ()) -> None:
    for name in VIEWS:
        if name not in seen and name not in above and re.search(rf"\b{name}\b", body):
            _needed(VIEWS[name], seen, (*above, name))
            if name not in seen:
                seen.append(name)


def full_sql(key: str) -> str:
    body, needed = CHECKS[key].strip(), []
    _needed(body, needed)
    if not needed:
        return body
    views = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in needed)
    if body[:5].upper() == "WITH ":
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"


def load() -> None:
    """Import every catalogue module, which fills the registry."""
    from cartloom.plans import (  # noqa: F401
        queries_campaigns,
        queries_churn,
        queries_cleaning,
        queries_customers,
        queries_models,
        queries_profile,
        queries_quality,
        queries_sales,
        queries_sources,
    )
