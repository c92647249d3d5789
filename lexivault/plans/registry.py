"""All queries and their SQL: those of the core modules; the entry module adds those of optional subpackages."""

from __future__ import annotations

from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from lexivault.plans import cohort, leakage, matching, metrics, packed, review, sections, selection

Query = Callable[[SparkSession, str], DataFrame]
MODULES: list[ModuleType] = [packed, leakage, cohort, metrics, selection, sections, matching, review]


def queries() -> dict[str, Query]:
    return {name: run for module in MODULES for name, run in module.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.oracle_sql().items()}
