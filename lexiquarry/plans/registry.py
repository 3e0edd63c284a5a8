"""Registered queries and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import branches, papers
from . import queries as q


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.j3_near_duplicates(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return q.QUERIES | papers.QUERIES | branches.QUERIES


def oracle_sql() -> dict[str, str]:
    return q.ORACLES | papers.ORACLES | branches.ORACLES
