"""Distinct counts from sketches that merge: kept by project and day, put together for weeks, months and populations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterfold.functions.predicates import manual_run

#: What is counted, and in which rows.
COUNTED = {
    "active_users": lambda: F.col("user_id"),
    "manual_users": lambda: F.when(manual_run(), F.col("user_id")),
    "runs": lambda: F.col("run_id"),
    "chats": lambda: F.col("conversation_id"),
    "tools_used": lambda: F.col("tool_name"),
    "models_used": lambda: F.col("model_name"),
}


def daily_sketches(events: DataFrame, names: list[str], lg: int = 12) -> DataFrame:
    """project_id, day and a sketch of 2^lg registers for each count: a few kilobytes whatever is in it."""
    return events.groupBy("project_id", F.to_date("ts").alias("day")).agg(*[F.hll_sketch_agg(COUNTED[n](), F.lit(lg)).alias(n) for n in names])


def union_counts(sketches: DataFrame, names: list[str], *by: Column) -> DataFrame:
    """The counts of all sketches that a group has: the same as from one sketch of all its rows.

    The standard error is about 1.04 / 2^(lg / 2), 1.6 % at 12; counts of up to some hundred are exact.
    """
    return sketches.groupBy(*by).agg(*[F.hll_sketch_estimate(F.hll_union_agg(n)).alias(n) for n in names])


def active_users_trend(events: DataFrame, granularity: str = "day", approx: bool = False) -> DataFrame:
    """Active users, and those who ran something by hand, by day, week or month: exact, or from daily sketches."""
    names = ["active_users", "manual_users"]
    if approx:
        return union_counts(daily_sketches(events, names), names, F.to_date(F.date_trunc(granularity, "day")).alias("bucket"))
    return events.groupBy(F.to_date(F.date_trunc(granularity, "ts")).alias("bucket")).agg(*[F.count_distinct(COUNTED[n]()).alias(n) for n in names])
