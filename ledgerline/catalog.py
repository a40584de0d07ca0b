"""Registry of the engine's own queries and of the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.plans import flows, integrity, relational

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = relational.QUERIES | integrity.QUERIES | flows.QUERIES
ORACLES: dict[str, str] = relational.ORACLES | integrity.ORACLES | flows.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.flagship(spark, sf_dir)
