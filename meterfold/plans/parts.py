"""Names for filters, keys and measures of reports, each as a column expression and as SQL for the oracle."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterfold.functions import columns as C
from meterfold.functions import predicates as P
from meterfold.sources.fixtures import DIMENSIONS, RAW_EVENTS, sql_for

PROJECT, USER, AGENT, TOOL, SKILL = 2, 7, 3, "kit-1__tool_4", 5
PERIOD = P.Period(datetime.datetime(1996, 3, 1), datetime.datetime(1996, 12, 31, 23, 59, 59))
MONTH, NEXT_MONTH = datetime.datetime(1996, 6, 1), datetime.datetime(1996, 7, 1)

_SPAN = f"ts BETWEEN TIMESTAMP '{PERIOD.start}' AND TIMESTAMP '{PERIOD.end}'"
_HUMAN = "user_id <> 0 AND (user_email IS NULL OR (user_email <> 'system@service.invalid' AND user_email NOT LIKE 'system_user_%@service.invalid'))"
_AGENT_ROW = "(COALESCE(root_entity_type IN ('application', 'pipeline'), FALSE) AND entity_type IS DISTINCT FROM 'evaluation')"
_MANUAL = "(trigger_source IS NULL OR trigger_source IN ('chat', 'api', 'mcp'))"
_RUN_ROW = "COALESCE(entity_id = root_entity_id AND entity_type = root_entity_type, FALSE)"
_TOKENS = "(billable_input_tokens + output_tokens + cache_read_tokens + cache_creation_tokens)"
_EVAL = "entity_type IS NOT DISTINCT FROM 'evaluation'"
_BASE = f"project_id = {PROJECT} AND event_type IN ('llm', 'tool') AND {_SPAN} AND {_HUMAN}"
_MODEL = f"project_id = {PROJECT} AND event_type = 'llm' AND {_SPAN}"
_CHATS = f"{_BASE} AND conversation_id LIKE '________-____-____-____-____________'"
_SKILL_ID = "CASE WHEN event_type = 'skill' THEN entity_id WHEN root_entity_type = 'skill' THEN root_entity_id END"
_SKILL_PROJECT = "CASE WHEN event_type = 'skill' AND regexp_matches(json_extract_string(meta, '$.skill_project_id'), '^[1-9][0-9]{0,8}$') THEN CAST(json_extract_string(meta, '$.skill_project_id') AS BIGINT) ELSE COALESCE(root_entity_project_id, project_id) END"
_SKILLS = f"project_id = {PROJECT} AND event_type IN ('llm', 'tool', 'skill') AND {_SPAN} AND {_HUMAN} AND ({_SKILL_ID}) IS NOT NULL"
_BUDGET = f"project_id = {PROJECT} AND event_type = 'llm' AND ts >= TIMESTAMP '{MONTH}' AND ts < TIMESTAMP '{NEXT_MONTH}' AND budget_exempt IS NOT TRUE"


def _base() -> Column:
    return P.base_filters(PROJECT, PERIOD)


def _skills() -> Column:
    return P.base_filters(PROJECT, PERIOD, ("llm", "tool", "skill")) & C.skill_id().isNotNull()


FILTERS = {
    "base": (_base, _BASE),
    "model": (lambda: P.model_call_filters(PROJECT, PERIOD), _MODEL),
    "manual": (lambda: _base() & P.manual_run(), f"{_BASE} AND {_MANUAL}"),
    "automated": (lambda: P.model_call_filters(PROJECT, PERIOD) & ~P.manual_run(), f"{_MODEL} AND NOT {_MANUAL}"),
    "model_skill": (lambda: P.model_call_filters(PROJECT, PERIOD) & P.is_skill_run_row(), f"{_MODEL} AND root_entity_type = 'skill'"),
    "model_agent": (lambda: P.model_call_filters(PROJECT, PERIOD) & P.is_agent_row(), f"{_MODEL} AND {_AGENT_ROW}"),
    "model_eval": (lambda: P.model_call_filters(PROJECT, PERIOD) & P.is_evaluation_row(), f"{_MODEL} AND {_EVAL}"),
    "tool_spend": (lambda: P.base_filters(PROJECT, PERIOD, ("tool_cost",)) & P.counted(), f"project_id = {PROJECT} AND event_type = 'tool_cost' AND {_SPAN} AND {_HUMAN} AND budget_exempt IS NOT TRUE"),
    "user": (lambda: _base() & (F.col("user_id") == USER), f"{_BASE} AND user_id = {USER}"),
    "tools": (lambda: _base() & F.col("tool_name").isNotNull(), f"{_BASE} AND tool_name IS NOT NULL"),
    "tool": (lambda: _base() & (F.col("tool_name") == TOOL), f"{_BASE} AND tool_name = '{TOOL}'"),
    "agents": (lambda: _base() & P.is_agent_row(), f"{_BASE} AND {_AGENT_ROW}"),
    "agent": (lambda: _base() & P.is_agent_row() & (F.col("root_entity_id") == AGENT), f"{_BASE} AND {_AGENT_ROW} AND root_entity_id = {AGENT}"),
    "agent_eval": (lambda: P.model_call_filters(PROJECT, PERIOD) & P.is_evaluation_row() & F.col("root_entity_type").isin(*P.AGENT_TYPES) & (F.col("root_entity_id") == AGENT), f"{_MODEL} AND {_EVAL} AND root_entity_type IN ('application', 'pipeline') AND root_entity_id = {AGENT}"),
    "chats": (lambda: P.chat_filters(PROJECT, PERIOD), _CHATS),
    "skills": (_skills, _SKILLS),
    "skill": (lambda: _skills() & (C.skill_id() == SKILL), f"{_SKILLS} AND ({_SKILL_ID}) = {SKILL}"),
    "budget": (lambda: P.budget_filters(PROJECT, MONTH, NEXT_MONTH), _BUDGET),
    "all": (lambda: F.lit(True), "TRUE"),
}

KEYS = {
    **{c: (lambda c=c: F.col(c), c) for c in ("user_id", "event_type", "model_name", "tool_name", "root_entity_type", "root_entity_id", "root_entity_version_id", "entity_type", "entity_id", "run_id", "conversation_id", "trigger_source", "project_id")},
    "day": (lambda: F.to_date("ts").cast("string"), "CAST(CAST(ts AS DATE) AS VARCHAR)"),
    "week": (lambda: C.bucket("week").cast("string"), "CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR)"),
    "month": (lambda: C.bucket("month").cast("string"), "CAST(CAST(date_trunc('month', ts) AS DATE) AS VARCHAR)"),
    "scope": (C.model_scope, "CASE WHEN budget_exempt IS TRUE THEN 'own' ELSE 'shared' END"),
    "root_project": (C.root_project, "COALESCE(root_entity_project_id, project_id)"),
    "participant": (C.participant_type, "CASE WHEN root_entity_type IS NULL THEN 'model' WHEN root_entity_type = 'application' THEN 'agent' ELSE root_entity_type END"),
    "skill_id": (C.skill_id, _SKILL_ID),
    "skill_project": (C.skill_project, _SKILL_PROJECT),
    "feature": (lambda: F.get_json_object("meta", "$.feature"), "json_extract_string(meta, '$.feature')"),
    "backend": (lambda: F.get_json_object("meta", "$.backend"), "json_extract_string(meta, '$.backend')"),
    "source": (lambda: F.get_json_object("meta", "$.source"), "json_extract_string(meta, '$.source')"),
    "stripped_model": (lambda: C.strip_model_prefix("model_name"), r"regexp_replace(regexp_extract(model_name, '[^/]*$'), '^\d+_', '')"),
    "bare_tool": (lambda: C.bare_tool_name(), "list_last(string_split(tool_name, '__'))"),
}


def _n(condition: str) -> str:
    return f"CAST(COUNT(*) FILTER (WHERE {condition}) AS BIGINT)"


def _d(column: str, condition: str = "TRUE") -> str:
    return f"CAST(COUNT(DISTINCT CASE WHEN {condition} THEN {column} END) AS BIGINT)"


def _s(expression: str) -> str:
    return f"CAST(COALESCE(SUM({expression}), 0) AS BIGINT)"


SQL_MEASURES = {
    "events": "COUNT(*)",
    "llm_calls": _n("event_type = 'llm'"),
    "tool_runs": _n("event_type = 'tool'"),
    "agent_runs": _d("run_id", _AGENT_ROW),
    "agent_error_runs": _d("run_id", f"{_AGENT_ROW} AND is_error"),
    "skill_runs": _d("run_id", "root_entity_type = 'skill'"),
    "eval_runs": _d("entity_id", _EVAL),
    "runs": _d("run_id"),
    "error_runs": _d("run_id", "is_error"),
    "chats": _d("conversation_id"),
    "active_users": _d("user_id"),
    "manual_users": _d("user_id", _MANUAL),
    "tools_used": _d("tool_name"),
    "models_used": _d("model_name"),
    "errors": _n("is_error"),
    "avg_duration_ms": "AVG(duration_ms)",
    "tokens": _s(_TOKENS),
    "input_tokens": _s("billable_input_tokens"),
    "output_tokens": _s("output_tokens"),
    "cache_read_tokens": _s("cache_read_tokens"),
    "cache_creation_tokens": _s("cache_creation_tokens"),
    "cost_nano": _s("cost_nano_usd"),
    "input_cost_nano": _s("input_cost_nano_usd"),
    "output_cost_nano": _s("output_cost_nano_usd"),
    "cache_read_cost_nano": _s("cache_read_cost_nano_usd"),
    "cache_creation_cost_nano": _s("cache_creation_cost_nano_usd"),
    "eval_cost_nano": _s(f"CASE WHEN {_EVAL} THEN cost_nano_usd END"),
    "unpriced_calls": _n("cost_source = 'unpriced'"),
    "unparsed_calls": _n("token_source = 'unparsed'"),
    "unresolved_input": _n("cost_source <> 'unpriced' AND input_tokens > 0 AND input_cost_nano_usd = 0"),
    "unresolved_output": _n("cost_source <> 'unpriced' AND output_tokens > 0 AND output_cost_nano_usd = 0"),
    "first_ms": "epoch_ms(MIN(ts))",
    "last_ms": "epoch_ms(MAX(ts))",
    "started_ms": "epoch_ms(MIN(ts - duration_ms * INTERVAL '1' MILLISECOND))",
    "any_error": "COALESCE(BOOL_OR(is_error), FALSE)",
    "run_row_name": f"MAX(CASE WHEN {_RUN_ROW} THEN entity_name END)",
    "name": rf"regexp_replace(MAX(CASE WHEN {_RUN_ROW} THEN entity_name END), ' \(([^()]*)\)$', '')",
    "stored_email": "MAX(user_email)",
    "max_project": "MAX(COALESCE(root_entity_project_id, project_id))",
}

_ctes = {"raw": RAW_EVENTS, "ev": "SELECT *, COALESCE(root_entity_project_id, project_id) AS root_project FROM raw WHERE arrival = 1", **DIMENSIONS}


def with_events(query: str) -> str:
    """query behind the tables that it may read: raw, ev and the dimensions."""
    named = [f"{n} AS ({sql_for(t, 'VARCHAR')})" for n, t in _ctes.items()]
    return f"WITH {', '.join(named)} {query}"
