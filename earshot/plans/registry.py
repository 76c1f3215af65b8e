"""All queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from earshot.plans import rest, stats
from earshot.plans.views import with_views

Query = Callable[[SparkSession, str], DataFrame]

_GROUPS = [stats, rest]


def queries() -> dict[str, Query]:
    return {name: build for group in _GROUPS for name, (build, _) in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for group in _GROUPS for name, (_, sql) in group.QUERIES.items() if sql}
