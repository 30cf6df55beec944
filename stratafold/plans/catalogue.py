"""All registered queries over the supplied tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratafold.plans import agg_demos, catalog_demos, graph_demos, job_demos, join_demos, record_demos, registry, report_demos, scalar_demos, window_demos  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
