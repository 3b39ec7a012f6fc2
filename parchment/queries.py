"""Every named query and its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parchment.plans import PLANS


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for plan in PLANS for name, (run, _) in plan.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, (_, sql) in plan.items() if sql}
