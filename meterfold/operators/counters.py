"""Spend counters: built from events, compared with them, and repaired by signed deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterfold.functions.columns import zero
from meterfold.functions.predicates import counted

KEYS = ["project_id", "user_id", "period_kind", "period_start", "model_name"]
VALUES = ["input_tokens", "output_tokens", "cost_nano_usd", "call_count"]


def counter_deltas(events: DataFrame) -> DataFrame:
    """What each event adds: a model call to its project (user 0) and its member, a paid tool likewise under its feature.

    Model calls that a budget doesn't count, and those of actor 0 as a member, add nothing.
    """
    calls = events.where((F.col("event_type") == "llm") & counted()).select("project_id", "user_id", F.trunc("ts", "MM").alias("period_start"), F.lit("").alias("model_name"), zero("billable_input_tokens").alias("input_tokens"), zero("output_tokens").alias("output_tokens"), zero("cost_nano_usd").alias("cost_nano_usd"))
    feature = F.get_json_object("meta", "$.feature")
    tools = events.where((F.col("event_type") == "tool_cost") & counted() & feature.isNotNull()).select("project_id", "user_id", F.trunc("ts", "MM").alias("period_start"), feature.alias("model_name"), F.lit(0).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"), zero("cost_nano_usd").alias("cost_nano_usd"))
    both = calls.unionByName(tools)
    owners = F.when(F.col("user_id") != 0, F.array(F.lit(0).cast("long"), "user_id")).otherwise(F.array(F.lit(0).cast("long")))
    return both.withColumn("user_id", F.explode(owners)).withColumn("period_kind", F.lit("month"))


def build_counters(events: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in VALUES[:3]]
    return counter_deltas(events).groupBy(*KEYS).agg(*sums, F.count("*").alias("call_count"))


def counter_drift(facts: DataFrame, counters: DataFrame) -> DataFrame:
    """Keys where counters differ from facts: both values and the difference of each measure; a missing side is 0."""
    left = facts.select(*KEYS, *[F.col(v).alias(f"fact_{v}") for v in VALUES])
    right = counters.select(*KEYS, *[F.col(v).alias(f"counter_{v}") for v in VALUES])
    joined = left.join(right, KEYS, "full_outer").fillna(0, [f"{s}_{v}" for s in ("fact", "counter") for v in VALUES])
    differs = F.lit(False)
    for v in VALUES:
        joined = joined.withColumn(f"delta_{v}", F.col(f"fact_{v}") - F.col(f"counter_{v}"))
        differs = differs | (F.col(f"delta_{v}") != 0)
    return joined.where(differs)


def counter_repair(counters: DataFrame, drift: DataFrame) -> DataFrame:
    """Counters after the deltas of drifting keys are added."""
    deltas = drift.select(*KEYS, *[F.col(f"delta_{v}").alias(v) for v in VALUES])
    return counters.select(*KEYS, *VALUES).unionByName(deltas).groupBy(*KEYS).agg(*[F.sum(v).alias(v) for v in VALUES])


def reconcile_history(history: DataFrame, run: DataFrame, keep: int = 168) -> DataFrame:
    """History with one more run, its latest rows only; it has one row a run."""
    newest = Window.orderBy(F.col("ran_at").desc())
    return history.unionByName(run).withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= keep).drop("_n")


def budget_breach(events: DataFrame, limits: DataFrame) -> DataFrame:
    """The first call at which a month's running spend passes the limit, for each project (user 0) and each member.

    limits: project_id, project_limit_nano, member_limit_nano; null is no limit.
    """
    calls = events.where((F.col("event_type") == "llm") & counted())
    owners = F.when(F.col("user_id") != 0, F.array(F.lit(0).cast("long"), "user_id")).otherwise(F.array(F.lit(0).cast("long")))
    own = calls.select("project_id", F.explode(owners).alias("user_id"), F.trunc("ts", "MM").alias("period_start"), F.to_date("ts").alias("day"), "ts", "idempotency_key", zero("cost_nano_usd").alias("cost"))
    limit = F.when(F.col("user_id") == 0, F.col("project_limit_nano")).otherwise(F.col("member_limit_nano"))
    key = ["project_id", "user_id", "period_start"]
    days = day_sums(own, key).join(limits.select("project_id", "project_limit_nano", "member_limit_nano"), "project_id").withColumn("limit_nano", limit)
    reached = days.where("before <= limit_nano AND before + day_cost > limit_nano").select(*key, "day", "before", "limit_nano")
    running = within_days(own.join(reached, [*key, "day"]), key).where("running_nano > limit_nano")
    first = running.groupBy(*key).agg(F.min(F.struct("running_nano", "idempotency_key")).alias("x"), F.min("day").alias("day"))
    return first.select(*key, "day", F.col("x.running_nano").alias("running_nano"), F.col("x.idempotency_key").alias("idempotency_key"))


def day_sums(own: DataFrame, key: list[str]) -> DataFrame:
    """cost by key and day, and before: what the earlier days of the key cost."""
    days = own.groupBy(*key, "day").agg(F.sum("cost").alias("day_cost"))
    earlier = Window.partitionBy(*key).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return days.withColumn("before", F.coalesce(F.sum("day_cost").over(earlier), F.lit(0)))


def within_days(own: DataFrame, key: list[str]) -> DataFrame:
    """own with running_nano: before and what the day has cost up to a row.

    A window holds a day of a key, so that a hot key is spread over its days.
    """
    inside = Window.partitionBy(*key, "day").orderBy("ts", "idempotency_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return own.withColumn("running_nano", F.col("before") + F.sum("cost").over(inside))


def running_spend(events: DataFrame) -> DataFrame:
    """The month's spend of each project after each of its calls."""
    calls = events.where((F.col("event_type") == "llm") & counted())
    own = calls.select("project_id", F.trunc("ts", "MM").alias("period_start"), F.to_date("ts").alias("day"), "ts", "idempotency_key", zero("cost_nano_usd").alias("cost"))
    key = ["project_id", "period_start"]
    return within_days(own.join(day_sums(own, key).drop("day_cost"), [*key, "day"]), key).select(*key, "idempotency_key", "running_nano")


def write_counters(counters: DataFrame, path: str) -> None:
    """Counters on disk by their period, of which spend queries read one."""
    counters.write.partitionBy("period_start").parquet(path)
