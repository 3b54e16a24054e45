"""Registry of the engine's own queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casewright.plans import graphs, relational, reports, texts

_PLANS = (relational, graphs, texts, reports)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for p in _PLANS for name, q in p.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for p in _PLANS for name, sql in p.R.sql.items()}
