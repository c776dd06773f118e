"""Scalar expressions over events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterfold.functions.predicates import AGENT_TYPES, AUTOMATION_SOURCES

VERSION_SUFFIX = r" \(([^()]*)\)$"


def zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def total_tokens() -> Column:
    return zero("billable_input_tokens") + zero("output_tokens") + zero("cache_read_tokens") + zero("cache_creation_tokens")


def event_started_at() -> Column:
    return F.col("ts") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), zero("duration_ms").cast("decimal(18,6)") / 1000)


def root_project() -> Column:
    return F.coalesce("root_entity_project_id", "project_id")


def source_bucket(is_pipeline: Column) -> Column:
    """Where spend comes from; is_pipeline: whether the directory knows the root as a pipeline."""
    root = F.col("root_entity_type")
    return (
        F.when(F.col("trigger_source").isin(*AUTOMATION_SOURCES), "automations")
        .when(F.col("trigger_source") == "index", "indexing")
        .when(F.col("entity_type") == "evaluation", "evaluations")
        .when(root.isin(*AGENT_TYPES) & is_pipeline, "pipelines")
        .when(root == "pipeline", "pipelines")
        .when(root == "application", "agents")
        .when(root == "skill", "skills")
        .when(F.col("conversation_id").isNotNull(), "chat")
        .otherwise("external")
    )


def model_scope() -> Column:
    return F.when(F.col("budget_exempt").eqNullSafe(True), "own").otherwise("shared")


def strip_model_prefix(model: str) -> Column:
    return F.regexp_replace(F.substring_index(F.col(model), "/", -1), r"^\d+_", "")


def without_version(name: Column) -> Column:
    return F.regexp_replace(name, VERSION_SUFFIX, "")


def bucket(granularity: str, ts: str = "ts") -> Column:
    """Day, Monday of the week, or first of the month, as a date."""
    return F.to_date(F.date_trunc(granularity, F.col(ts)))


def bucket_end(granularity: str, start: Column) -> Column:
    return {"day": F.date_add(start, 1), "week": F.date_add(start, 7), "month": F.add_months(start, 1)}[granularity]


def cost_usd(nano: Column) -> Column:
    return F.bround(nano / 1e9, 9)


def cache_hit_rate(reads: Column, billable: Column, writes: Column) -> Column:
    prompt = billable + reads + writes
    return F.when(prompt > 0, F.bround(reads * 100 / prompt, 2))


def bare_tool_name(name: str = "tool_name") -> Column:
    return F.substring_index(F.col(name), "__", -1)


def cu_label(cu: Column, medium: Column, high: Column, extreme: Column) -> Column:
    return F.when(cu >= extreme, "X").when(cu >= high, "H").when(cu >= medium, "M").otherwise("L")


def percentile_of(value: Column, breakpoints: Column) -> Column:
    """Share of breakpoints at or below value, in percent of one more than there are; null without any."""
    below = F.size(F.filter(breakpoints, lambda b: b <= value))
    return F.when(F.size(breakpoints) > 0, F.bround(below * 100 / (F.size(breakpoints) + 1), 0).cast("int"))


def warning_level(spent: Column, limit: Column, threshold: Column) -> Column:
    """The highest of threshold, 90 and 95 percent that spend has reached; null below the first and from 100 on."""
    used = spent * 100 / limit
    reached = F.greatest(threshold, F.when(used >= 90, F.lit(90)), F.when(used >= 95, F.lit(95)))
    return F.when((limit > 0) & (used >= threshold) & (used < 100), reached)


def skill_id() -> Column:
    return F.when(F.col("event_type") == "skill", F.col("entity_id")).otherwise(F.when(is_skill_root(), F.col("root_entity_id")))


def is_skill_root() -> Column:
    return F.col("root_entity_type") == "skill"


def skill_project() -> Column:
    """From meta where it is a plain number of at most nine digits, else the root's project."""
    given = F.get_json_object("meta", "$.skill_project_id")
    return F.when((F.col("event_type") == "skill") & given.rlike("^[1-9][0-9]{0,8}$"), given.try_cast("long")).otherwise(root_project())


def participant_type() -> Column:
    root = F.col("root_entity_type")
    return F.when(root.isNull(), "model").when(root == "application", "agent").otherwise(root)


def redact_amounts(df, can_see: bool):
    """df without its money columns for readers who may not see amounts."""
    return df if can_see else df.drop(*[c for c in df.columns if "cost" in c or "spend" in c or c in ("limit_nano", "remaining_nano")])
