"""Reports as DataFrames: a filter, keys, measures; then labels, tails and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterfold.functions.columns import event_started_at, without_version
from meterfold.functions.measures import MEASURES
from meterfold.functions.predicates import is_run_row
from meterfold.plans.parts import FILTERS, KEYS, SQL_MEASURES

EXTRA = {
    "first_ms": lambda: F.unix_millis(F.min("ts")),
    "last_ms": lambda: F.unix_millis(F.max("ts")),
    "started_ms": lambda: F.unix_millis(F.min(event_started_at())),
    "name": lambda: without_version(F.max(F.when(is_run_row(), F.col("entity_name")))),
    "stored_email": lambda: F.max("user_email"),
    "max_project": lambda: F.max(F.coalesce("root_entity_project_id", "project_id")),
}


def measure(name: str) -> Column:
    return (EXTRA.get(name) or MEASURES[name])().alias(name)


def report(events: DataFrame, where: str, keys: list[str], measures: list[str]) -> DataFrame:
    """One scan: rows of the named filter, grouped by named keys, with named measures; without keys one row."""
    rows = events.where(FILTERS[where][0]())
    if keys:
        rows = rows.withColumns({f"_{k}": KEYS[k][0]() for k in keys})
        return rows.groupBy(*[F.col(f"_{k}").alias(k) for k in keys]).agg(*map(measure, measures))
    return rows.agg(*map(measure, measures))


def report_sql(where: str, keys: list[str], measures: list[str], source: str = "ev") -> str:
    columns = [f"{KEYS[k][1]} AS {k}" for k in keys] + [f"{SQL_MEASURES[m]} AS {m}" for m in measures]
    group = f" GROUP BY {', '.join(str(k + 1) for k in range(len(keys)))}" if keys else ""
    return f"SELECT {', '.join(columns)} FROM {source} WHERE {FILTERS[where][1]}{group}"


def top(df: DataFrame, by: str, keys: list[str], n: int) -> DataFrame:
    return df.orderBy(F.col(by).desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in keys]).limit(n)


def top_sql(query: str, by: str, keys: list[str], n: int) -> str:
    return f"SELECT * FROM ({query}) ORDER BY {by} DESC NULLS LAST, {', '.join(f'{k} ASC NULLS LAST' for k in keys)} LIMIT {n}"
