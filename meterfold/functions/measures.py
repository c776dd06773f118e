"""Measures that reports share: each is one conditional aggregate, so that a report is one scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterfold.functions.columns import event_started_at, total_tokens, zero
from meterfold.functions.predicates import is_agent_row, is_evaluation_row, is_run_row, is_skill_run_row, manual_run


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def _sum(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0))


def _distinct(condition: Column, name: str) -> Column:
    return F.countDistinct(F.when(condition, F.col(name)))


def _missing(name: str) -> Column:
    """Priced calls whose tokens were stored at a cost of zero."""
    return _count((F.col("cost_source") != "unpriced") & (zero(name) > 0) & (zero({"input_tokens": "input_cost_nano_usd", "output_tokens": "output_cost_nano_usd"}[name]) == 0))


MEASURES = {
    "events": lambda: F.count("*"),
    "llm_calls": lambda: _count(F.col("event_type") == "llm"),
    "tool_runs": lambda: _count(F.col("event_type") == "tool"),
    "agent_runs": lambda: _distinct(is_agent_row(), "run_id"),
    "agent_error_runs": lambda: _distinct(is_agent_row() & F.col("is_error"), "run_id"),
    "skill_runs": lambda: _distinct(is_skill_run_row(), "run_id"),
    "eval_runs": lambda: F.countDistinct(F.when(is_evaluation_row(), F.col("entity_id"))),
    "runs": lambda: F.countDistinct("run_id"),
    "error_runs": lambda: _distinct(F.col("is_error"), "run_id"),
    "chats": lambda: F.countDistinct("conversation_id"),
    "active_users": lambda: F.countDistinct("user_id"),
    "manual_users": lambda: _distinct(manual_run(), "user_id"),
    "tools_used": lambda: F.countDistinct("tool_name"),
    "models_used": lambda: F.countDistinct("model_name"),
    "errors": lambda: _count(F.col("is_error")),
    "avg_duration_ms": lambda: F.avg("duration_ms"),
    "tokens": lambda: _sum(total_tokens()),
    "input_tokens": lambda: _sum(zero("billable_input_tokens")),
    "output_tokens": lambda: _sum(zero("output_tokens")),
    "cache_read_tokens": lambda: _sum(zero("cache_read_tokens")),
    "cache_creation_tokens": lambda: _sum(zero("cache_creation_tokens")),
    "cost_nano": lambda: _sum(zero("cost_nano_usd")),
    "input_cost_nano": lambda: _sum(zero("input_cost_nano_usd")),
    "output_cost_nano": lambda: _sum(zero("output_cost_nano_usd")),
    "cache_read_cost_nano": lambda: _sum(zero("cache_read_cost_nano_usd")),
    "cache_creation_cost_nano": lambda: _sum(zero("cache_creation_cost_nano_usd")),
    "eval_cost_nano": lambda: _sum(F.when(is_evaluation_row(), F.col("cost_nano_usd")).otherwise(0)),
    "unpriced_calls": lambda: _count(F.col("cost_source") == "unpriced"),
    "unparsed_calls": lambda: _count(F.col("token_source") == "unparsed"),
    "unresolved_input": lambda: _missing("input_tokens"),
    "unresolved_output": lambda: _missing("output_tokens"),
    "first_ts": lambda: F.min("ts"),
    "last_ts": lambda: F.max("ts"),
    "started_at": lambda: F.min(event_started_at()),
    "any_error": lambda: F.coalesce(F.max("is_error"), F.lit(False)),
    "run_row_name": lambda: F.max(F.when(is_run_row(), F.col("entity_name"))),
}
COST_SPLIT = ["cost_nano", "input_cost_nano", "output_cost_nano", "cache_read_cost_nano", "cache_creation_cost_nano"]


def measures(*names: str) -> list[Column]:
    return [MEASURES[n]().alias(n) for n in names]
