"""Every registered query, with its check statement where SQL can state one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillroll.plans import (
    queries_customers, queries_experiments, queries_models, queries_series, queries_sources, queries_tables,
)
from tillroll.plans.present import present
from tillroll.plans.star_tables import StarTables

_MODULES = (queries_tables, queries_customers, queries_series, queries_experiments, queries_models, queries_sources)


def _all() -> dict:
    out = {}
    for module in _MODULES:
        for name, entry in module.QUERIES.items():
            if name in out:
                raise ValueError(f"query {name} is registered twice")
            out[name] = entry
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(build):
        return lambda spark, sf_dir: present(build(StarTables(spark, sf_dir)))

    return {name: runner(build) for name, (build, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
