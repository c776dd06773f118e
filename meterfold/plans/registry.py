"""All queries over a data folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from meterfold.plans import catalog, jobs, streams  # noqa: F401  both add to the catalogue
from meterfold.sources.store import Store


def _run(query: Callable[[Store], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return query(Store(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(_run, query) for name, query in catalog.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(catalog.ORACLE)
