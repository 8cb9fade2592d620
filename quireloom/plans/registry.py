"""All queries on the supplied tables and their SQL, by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quireloom.plans.staging import ship_package

Query = Callable[[SparkSession, str], DataFrame]

_MODULES: tuple[str, ...] = (
    "quireloom.plans.texts",
    "quireloom.plans.segments",
    "quireloom.plans.reviews",
    "quireloom.plans.assemblies",
)

#: The query that entry() runs.
FLAGSHIP = "agg1_run_summary"


def ready(query: Query) -> Query:
    """``query`` with the package made importable on the workers first."""

    def run(spark: SparkSession, data_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, data_dir)

    run.__doc__ = query.__doc__
    return run


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name in _MODULES:
        found |= {k: ready(q) for k, q in importlib.import_module(name).QUERIES.items()}
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in _MODULES:
        found |= importlib.import_module(name).SQL
    return found
