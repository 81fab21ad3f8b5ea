"""Names and bodies of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog_code, catalog_flows, catalog_history, catalog_risk

Query = Callable[[SparkSession, str], DataFrame]
_CATALOGS = (catalog_history, catalog_code, catalog_risk, catalog_flows)


def queries() -> dict[str, Query]:
    return {k: v for c in _CATALOGS for k, v in c.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for c in _CATALOGS for k, v in c.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["s1_ingest_commits"](spark, sf_dir)
