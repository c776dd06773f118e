"""Every report and operator as a query over a data folder, with the SQL that must give the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterfold.functions import columns as C
from meterfold.functions import predicates as P
from meterfold.functions.measures import COST_SPLIT
from meterfold.operators import page as pages
from meterfold.operators.complexity import EVENTS_A_TASK
from meterfold.operators.sketches import active_users_trend
from meterfold.plans.parts import AGENT, FILTERS, PERIOD, PROJECT, SQL_MEASURES, USER, with_events
from meterfold.plans.reports import measure, report, report_sql, top, top_sql
from meterfold.sources.store import Store

QUERIES: dict[str, Callable[[Store], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def add(name: str, query: Callable[[Store], DataFrame], sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = with_events(sql)


def plain(name: str, where: str, keys: list[str], measures: list[str], by: str | None = None, n: int = 0) -> None:
    """A grouped report, or its first n rows by a measure with the keys as tie-break."""
    sql = report_sql(where, keys, measures)
    if by:
        add(name, lambda s: top(report(s.events, where, keys, measures), by, keys, n), top_sql(sql, by, keys, n))
    else:
        add(name, lambda s: report(s.events, where, keys, measures), sql)


COST = ["llm_calls", "tokens", *COST_SPLIT]
LIST = ["runs", "llm_calls", "tool_runs", "errors", "avg_duration_ms", "tokens", "cost_nano", "active_users"]

# --- overview and activity
PEOPLE, MODELS = ["active_users", "manual_users", "agent_runs", "agent_error_runs", "skill_runs", "tool_runs", "chats"], ["llm_calls", "tokens", "cost_nano", "unpriced_calls"]


def overview_kpis(s: Store) -> DataFrame:
    people, models = report(s.events, "base", [], PEOPLE), report(s.events, "model", [], MODELS)
    members = s.members.where(F.col("project_id") == PROJECT).agg(F.countDistinct("user_id").alias("members"))
    joined = people.crossJoin(models).crossJoin(members)  # three rows of one
    return joined.withColumn("adoption", F.col("active_users") / F.greatest("members", "active_users"))


add("overview_kpis", overview_kpis, f"SELECT *, active_users / GREATEST(members, active_users) AS adoption FROM ({report_sql('base', [], PEOPLE)}) a CROSS JOIN ({report_sql('model', [], MODELS)}) b CROSS JOIN (SELECT COUNT(DISTINCT user_id) AS members FROM members WHERE project_id = {PROJECT}) c")

_OUTSIDE = f"SELECT user_id FROM super_admins WHERE user_id NOT IN (SELECT user_id FROM members WHERE project_id = {PROJECT})"


def overview_top_users(s: Store) -> DataFrame:
    own = P.outsiders_anti(s.events, s.members.where(F.col("project_id") == PROJECT), s.super_admins)
    return pages.join_user(top(report(own, "manual", ["user_id"], ["events", "stored_email"]), "events", ["user_id"], 5), s.users)


_USER_LABEL = "CASE WHEN t.user_id = 0 THEN 'System' ELSE COALESCE(u.email, t.stored_email) END AS user_label, t.user_id <> 0 AND u.email IS NULL AS user_deleted"
add("overview_top_users", overview_top_users, f"SELECT t.user_id, t.events, {_USER_LABEL} FROM (" + top_sql(report_sql("manual", ["user_id"], ["events", "stored_email"], f"(SELECT * FROM ev WHERE user_id NOT IN ({_OUTSIDE}))"), "events", ["user_id"], 5) + ") t LEFT JOIN users u ON u.user_id = t.user_id")

add("outsiders_anti", lambda s: report(P.outsiders_anti(s.events, s.members.where(F.col("project_id") == PROJECT), s.super_admins), "base", ["user_id"], ["events"]), report_sql("base", ["user_id"], ["events"], f"(SELECT * FROM ev WHERE user_id NOT IN ({_OUTSIDE}))"))


def overview_daily(s: Store) -> DataFrame:
    people = report(s.events, "base", ["day"], ["active_users", "agent_runs", "tool_runs"])
    return people.join(report(s.events, "model", ["day"], MODELS), "day", "full_outer").fillna(0)


_DAILY = ", ".join(f"COALESCE({c}, 0) AS {c}" for c in ["active_users", "agent_runs", "tool_runs", *MODELS])
_DAILY_SQL = f"SELECT COALESCE(a.day, b.day) AS day, {_DAILY} FROM ({report_sql('base', ['day'], ['active_users', 'agent_runs', 'tool_runs'])}) a FULL JOIN ({report_sql('model', ['day'], MODELS)}) b ON a.day = b.day"
add("overview_daily", overview_daily, _DAILY_SQL)
add("activity_merge", lambda s: overview_daily(s).select("day", "active_users", "llm_calls"), f"SELECT day, active_users, llm_calls FROM ({_DAILY_SQL})")
plain("overview_models", "model", ["model_name", "scope"], ["llm_calls", "active_users", "avg_duration_ms"], "llm_calls", 20)


def automated_activity(s: Store) -> DataFrame:
    rows = s.events.where(FILTERS["automated"][0]()).withColumn("root_project", C.root_project())
    rows = pages.join_application(rows, s.applications)
    return rows.groupBy("trigger_source", F.coalesce("kind", "root_entity_type").alias("kind")).agg(measure("runs"), measure("llm_calls"), measure("cost_nano"))


_APPS = "LEFT JOIN applications ap ON ap.project_id = ev.root_project AND ap.id = ev.root_entity_id"
_EV_APP = f"(SELECT ev.*, ap.kind AS app_kind, ap.name AS app_name FROM ev {_APPS})"
add("automated_activity", automated_activity, f"SELECT trigger_source, COALESCE(app_kind, root_entity_type) AS kind, {SQL_MEASURES['runs']} AS runs, {SQL_MEASURES['llm_calls']} AS llm_calls, {SQL_MEASURES['cost_nano']} AS cost_nano FROM {_EV_APP} WHERE {FILTERS['automated'][1]} GROUP BY 1, 2")
for g in ("day", "week", "month"):
    plain(f"active_users_trend_{g}" if g != "week" else "active_users_trend", "base", [g], ["active_users", "manual_users"])
add(
    "active_users_sketch",
    lambda s: functools.reduce(DataFrame.unionByName, [active_users_trend(s.events.where(FILTERS["base"][0]()), g, approx=True).withColumn("granularity", F.lit(g)) for g in ("day", "week", "month")]).withColumn("bucket", F.col("bucket").cast("string")),
    " UNION ALL ".join(f"SELECT CAST(CAST(date_trunc('{g}', ts) AS DATE) AS VARCHAR) AS bucket, {SQL_MEASURES['active_users']} AS active_users, {SQL_MEASURES['manual_users']} AS manual_users, '{g}' AS granularity FROM ev WHERE {FILTERS['base'][1]} GROUP BY 1" for g in ("day", "week", "month")),
)
plain("event_type_health", "base", ["event_type"], ["events", "errors", "avg_duration_ms"])
add("available_roles", lambda s: s.members.select("role").distinct().where(~F.col("role").isin("super_admin", "system")), "SELECT DISTINCT role FROM members WHERE role NOT IN ('super_admin', 'system')")


def role_filtered(s: Store) -> DataFrame:
    stamped = s.events.where(FILTERS["base"][0]())
    return P.role_filter(stamped, s.members, ["editor"]).groupBy("user_id").agg(measure("events"))


add("role_filter", role_filtered, f"SELECT user_id, COUNT(*) AS events FROM ev WHERE {FILTERS['base'][1]} AND (project_id, user_id) IN (SELECT project_id, user_id FROM members WHERE role = 'editor') GROUP BY 1")
add("search_like", lambda s: s.events.where(FILTERS["tools"][0]() & P.search_like("tool_name", "TOOL_4")).groupBy("tool_name").agg(measure("events")), f"SELECT tool_name, COUNT(*) AS events FROM ev WHERE {FILTERS['tools'][1]} AND tool_name ILIKE '%TOOL_4%' GROUP BY 1")

# --- costs
COST_KPIS = [*COST, "runs", "eval_runs", "eval_cost_nano", "unpriced_calls", "unresolved_input", "unresolved_output"]
add("cost_kpis", lambda s: report(s.events, "model", [], COST_KPIS).withColumn("cost_usd", C.cost_usd(F.col("cost_nano"))).withColumn("avg_nano", F.col("cost_nano") / F.col("llm_calls")), f"SELECT *, round_even(cost_nano / 1e9, 9) AS cost_usd, cost_nano / llm_calls AS avg_nano FROM ({report_sql('model', [], COST_KPIS)})")


def tail_sql(query: str, keys: list[str], numbers: list[str], by: str, n: int) -> str:
    rank = f"ROW_NUMBER() OVER (ORDER BY {by} DESC, {', '.join(f'{k} ASC NULLS LAST' for k in keys)})"
    shown = ", ".join(f"CASE WHEN rn <= {n} THEN {k} END AS {k}" for k in keys)
    sums = ", ".join(f"CAST(SUM({m}) AS BIGINT) AS {m}" for m in numbers)
    return f"SELECT {shown}, rn > {n} AS is_other, {sums} FROM (SELECT *, {rank} AS rn FROM ({query})) GROUP BY {', '.join(str(i + 1) for i in range(len(keys)))}, rn > {n}, CASE WHEN rn <= {n} THEN rn END"


def tailed(name: str, where: str, keys: list[str], numbers: list[str], n: int) -> None:
    add(name, lambda s: pages.collapse_tail(report(s.events, where, keys, numbers), keys, "cost_nano", n), tail_sql(report_sql(where, keys, numbers), keys, numbers, "cost_nano", n))


tailed("cost_by_model", "model", ["model_name", "scope"], COST, 8)
tailed("cost_by_agent", "model_agent", ["root_entity_type", "root_entity_id", "root_project"], [*COST, "runs"], 10)
tailed("cost_by_skill", "model_skill", ["root_entity_id", "root_project"], [*COST, "runs"], 5)
tailed("collapse_tail", "model", ["user_id"], ["llm_calls", "cost_nano"], 3)
plain("cost_by_evaluation", "model_eval", ["root_entity_id", "root_entity_version_id"], [*COST, "eval_runs"])


def cost_by_user(s: Store) -> DataFrame:
    return pages.join_user(top(report(s.events, "model", ["user_id"], [*COST, "stored_email"]), "cost_nano", ["user_id"], 20), s.users)


add("cost_by_user", cost_by_user, f"SELECT t.* EXCLUDE (stored_email), {_USER_LABEL} FROM ({top_sql(report_sql('model', ['user_id'], [*COST, 'stored_email']), 'cost_nano', ['user_id'], 20)}) t LEFT JOIN users u ON u.user_id = t.user_id")
add("join_user", lambda s: pages.join_user(report(s.events, "base", ["user_id"], ["events", "stored_email"]), s.users), f"SELECT t.user_id, t.events, {_USER_LABEL} FROM ({report_sql('base', ['user_id'], ['events', 'stored_email'])}) t LEFT JOIN users u ON u.user_id = t.user_id")
plain("cost_by_tool_spend", "tool_spend", ["feature", "backend"], ["events", "cost_nano"])
plain("cost_daily", "model", ["day"], COST)
plain("cost_split", "model", ["scope"], COST_SPLIT)
plain("below_resolution", "model", ["model_name"], ["llm_calls", "unresolved_input", "unresolved_output", "unpriced_calls"])

# --- label joins
add("join_application", lambda s: pages.join_application(report(s.events, "model_agent", ["root_project", "root_entity_id"], ["cost_nano"]), s.applications), f"SELECT t.*, ap.name AS app_name, ap.kind AS kind FROM ({report_sql('model_agent', ['root_project', 'root_entity_id'], ['cost_nano'])}) t LEFT JOIN applications ap ON ap.project_id = t.root_project AND ap.id = t.root_entity_id")
add("join_skill", lambda s: pages.join_skill(report(s.events, "skills", ["skill_project", "skill_id"], ["events"]), s.skills), f"SELECT t.*, k.name AS skill_name, k.is_public AS is_public FROM ({report_sql('skills', ['skill_project', 'skill_id'], ['events'])}) t LEFT JOIN skills k ON k.project_id = t.skill_project AND k.id = t.skill_id")
_MODEL_LABEL = "CASE WHEN COUNT(*) OVER (PARTITION BY t.model_name) > 1 THEN CONCAT(COALESCE(m.display_name, a.any_name, t.model_name), CASE WHEN t.scope = 'own' THEN ' (project)' ELSE ' (shared)' END) ELSE COALESCE(m.display_name, a.any_name, t.model_name) END AS model_label"
_MODEL_JOIN = "LEFT JOIN models m ON m.model_name = t.model_name AND m.scope = t.scope LEFT JOIN (SELECT model_name, MIN(display_name) AS any_name FROM models GROUP BY 1) a ON a.model_name = t.model_name"
add("join_model", lambda s: pages.join_model(report(s.events, "model", ["model_name", "scope"], ["llm_calls"]), s.models), f"SELECT t.*, {_MODEL_LABEL} FROM ({report_sql('model', ['model_name', 'scope'], ['llm_calls'])}) t {_MODEL_JOIN}")
_CALLS_ONLY = "(SELECT * FROM ev WHERE event_type = 'llm')"
_LABELLED = f"SELECT t.*, {_MODEL_LABEL} FROM ({report_sql('all', ['model_name', 'scope'], ['llm_calls', 'cost_nano'], _CALLS_ONLY)}) t {_MODEL_JOIN}"


def label_totals(s: Store) -> DataFrame:
    """Calls and cost of all projects by the models' labels."""
    pairs = report(s.events.where("event_type = 'llm'"), "all", ["model_name", "scope"], ["llm_calls", "cost_nano"])
    return pages.join_model(pairs, s.models).groupBy("model_label").agg(F.sum("llm_calls").alias("llm_calls"), F.sum("cost_nano").alias("cost_nano"))


add("model_label", label_totals, f"SELECT model_label, CAST(SUM(llm_calls) AS BIGINT) AS llm_calls, CAST(SUM(cost_nano) AS BIGINT) AS cost_nano FROM ({_LABELLED}) GROUP BY 1")
_CHAT_LABEL = f"CASE WHEN c.chat_name IS NULL THEN 'Deleted chat' WHEN c.is_private AND c.author_id <> {USER} THEN 'Private chat' ELSE c.chat_name END AS chat_label"
add("private_chat_name", lambda s: pages.join_conversation(report(s.events, "chats", ["conversation_id"], ["events"]), s.conversations, USER), f"SELECT t.*, {_CHAT_LABEL} FROM ({report_sql('chats', ['conversation_id'], ['events'])}) t LEFT JOIN conversations c ON c.uuid = t.conversation_id")
add("join_feature_label", lambda s: pages.join_feature_label(report(s.events, "tool_spend", ["feature"], ["events"]), s.feature_labels), f"SELECT t.*, COALESCE(l.label, t.feature) AS label FROM ({report_sql('tool_spend', ['feature'], ['events'])}) t LEFT JOIN feature_labels l ON l.feature = t.feature")
add("version_label", lambda s: pages.join_version(report(s.events, "agents", ["root_entity_id", "root_entity_version_id"], ["run_row_name"]), s.versions.where("version_id < 3"), stored="run_row_name"), rf"SELECT t.*, COALESCE(v.version_name, NULLIF(regexp_extract(t.run_row_name, ' \(([^()]*)\)$', 1), ''), CASE WHEN t.root_entity_version_id IS NOT NULL THEN CONCAT('Version #', CAST(t.root_entity_version_id AS VARCHAR)) END) AS version_label FROM ({report_sql('agents', ['root_entity_id', 'root_entity_version_id'], ['run_row_name'])}) t LEFT JOIN (SELECT * FROM versions WHERE version_id < 3) v ON v.version_id = t.root_entity_version_id")

# --- users and tools
USERS = ["events", "llm_calls", "tool_runs", "agent_runs", "agent_error_runs", "skill_runs", "chats", "tools_used", "models_used", "errors", "avg_duration_ms", "tokens", "cost_nano", "last_ms", "stored_email"]
add("users_list", lambda s: pages.page(report(s.events, "base", ["user_id"], USERS), "tokens", ["user_id"], ["tokens", "events"], limit=20), top_sql(report_sql("base", ["user_id"], USERS), "tokens", ["user_id"], 20))
add("page", lambda s: pages.page(report(s.events, "base", ["user_id"], ["events", "avg_duration_ms"]), "events", ["user_id"], ["events"], limit=10, offset=5, nulls_last=True), f"SELECT * FROM ({report_sql('base', ['user_id'], ['events', 'avg_duration_ms'])}) ORDER BY events DESC NULLS LAST, user_id LIMIT 10 OFFSET 5")
plain("user_kpis", "user", [], ["events", "llm_calls", "tool_runs", "agent_runs", "chats", "tokens", "cost_nano", "errors"])
plain("user_models", "user", ["model_name", "scope"], ["llm_calls", "tokens", "cost_nano"])
plain("user_tools", "user", ["tool_name"], ["tool_runs", "errors"])
plain("user_agents", "user", ["root_entity_type", "root_entity_id"], ["agent_runs", "tokens", "cost_nano"], "agent_runs", 20)
plain("user_daily", "user", ["day"], ["events", "tokens", "cost_nano"])
plain("tools_list", "tools", ["tool_name"], ["tool_runs", "active_users", "avg_duration_ms", "errors"], "tool_runs", 20)
add("tool_kpis", lambda s: report(s.events, "tool", [], ["tool_runs", "active_users", "errors", "avg_duration_ms"]).withColumn("error_rate", F.when(F.col("tool_runs") > 0, F.bround(F.col("errors") * 100 / F.col("tool_runs"), 2))), f"SELECT *, CASE WHEN tool_runs > 0 THEN round_even(errors * 100 / tool_runs, 2) END AS error_rate FROM ({report_sql('tool', [], ['tool_runs', 'active_users', 'errors', 'avg_duration_ms'])})")
plain("tool_users", "tool", ["user_id"], ["tool_runs", "errors"])
plain("tool_agents", "tool", ["root_entity_type", "root_entity_id"], ["tool_runs", "errors", "runs"], "tool_runs", 20)
plain("tool_daily", "tool", ["day"], ["tool_runs", "errors"])
plain("bare_tool_name", "tools", ["bare_tool"], ["tool_runs"])
plain("strip_model_prefix", "all", ["stripped_model"], ["events"])

# --- agents and runs
AGENTS = ["runs", "error_runs", "active_users", "avg_duration_ms", "llm_calls", "tokens", "cost_nano", "max_project", "name"]
add("agents_list", lambda s: top(report(s.events, "agents", ["root_entity_id"], AGENTS).where(F.col("name").ilike("%agent%")).withColumn("tokens_per_call", F.when(F.col("llm_calls") > 0, F.col("tokens") / F.col("llm_calls"))), "cost_nano", ["root_entity_id"], 20), top_sql(f"SELECT *, CASE WHEN llm_calls > 0 THEN tokens / llm_calls END AS tokens_per_call FROM ({report_sql('agents', ['root_entity_id'], AGENTS)}) WHERE name ILIKE '%agent%'", "cost_nano", ["root_entity_id"], 20))
plain("agent_kpis", "agent", [], [*LIST, "error_runs", "chats", "run_row_name", "last_ms"])
add("agent_kind_project", lambda s: s.events.where(FILTERS["agent"][0]()).agg(F.when(F.max((C.root_project() == PROJECT).cast("int")) == 1, PROJECT).otherwise(F.max(C.root_project())).cast("long").alias("kind_project")), f"SELECT CAST(CASE WHEN MAX(CASE WHEN root_project = {PROJECT} THEN 1 ELSE 0 END) = 1 THEN {PROJECT} ELSE MAX(root_project) END AS BIGINT) AS kind_project FROM ev WHERE {FILTERS['agent'][1]}")
plain("agent_by_version", "agent", ["root_entity_version_id"], ["runs", "tokens", "cost_nano"])
add("agent_by_model", lambda s: report(s.events.where("event_type = 'llm'"), "agent", ["model_name", "scope"], ["runs", "llm_calls", "tokens", "cost_nano"]), report_sql("agent", ["model_name", "scope"], ["runs", "llm_calls", "tokens", "cost_nano"], "(SELECT * FROM ev WHERE event_type = 'llm')"))


def agent_by_trigger(s: Store) -> DataFrame:
    """Each run's first source; rows without run id keep their own and count tokens, not runs."""
    rows = s.events.where(FILTERS["agent"][0]())
    own = rows.groupBy("run_id", F.when(F.col("run_id").isNull(), F.col("trigger_source")).alias("own")).agg(F.min_by("trigger_source", F.when(F.col("trigger_source").isNotNull(), F.struct("ts", "idempotency_key"))).alias("first"), measure("tokens"), measure("cost_nano"))
    return own.groupBy(F.coalesce("own", "first").alias("trigger_source")).agg(F.count("run_id").alias("runs"), F.sum("tokens").alias("tokens"), F.sum("cost_nano").alias("cost_nano"))


add("agent_by_trigger", agent_by_trigger, f"SELECT trigger_source, COUNT(run_id) AS runs, CAST(SUM(tokens) AS BIGINT) AS tokens, CAST(SUM(cost_nano) AS BIGINT) AS cost_nano FROM (SELECT run_id, first AS trigger_source, {SQL_MEASURES['tokens']} AS tokens, {SQL_MEASURES['cost_nano']} AS cost_nano FROM (SELECT *, CASE WHEN run_id IS NULL THEN trigger_source ELSE FIRST_VALUE(trigger_source) OVER (PARTITION BY run_id ORDER BY trigger_source IS NULL, ts, idempotency_key) END AS first FROM ev WHERE {FILTERS['agent'][1]}) GROUP BY run_id, first) GROUP BY 1")
plain("agent_evaluation", "agent_eval", [], ["eval_runs", "tokens", "cost_nano"])
plain("agent_users", "agent", ["user_id"], ["runs", "tokens", "cost_nano"], "runs", 50)
add("agent_tools", lambda s: top(report(s.events.where("tool_name IS NOT NULL"), "agent", ["tool_name"], ["tool_runs", "errors"]), "tool_runs", ["tool_name"], 30), top_sql(report_sql("agent", ["tool_name"], ["tool_runs", "errors"], "(SELECT * FROM ev WHERE tool_name IS NOT NULL)"), "tool_runs", ["tool_name"], 30))
plain("agent_daily", "agent", ["day"], ["runs", "tokens", "cost_nano", "errors"])


def agent_skills(s: Store) -> DataFrame:
    own = s.events.where(P.base_filters(PROJECT, PERIOD, ("skill",)) & F.col("root_entity_type").isin(*P.AGENT_TYPES) & (F.col("root_entity_id") == AGENT))
    rows = P.eval_runs_anti(own, s.events).withColumn("skill_project", C.skill_project())
    return top(rows.groupBy("entity_id", "skill_project").agg(measure("events"), measure("runs")), "events", ["entity_id", "skill_project"], 30)


_AGENT_SKILLS = FILTERS["base"][1].replace("event_type IN ('llm', 'tool')", "event_type = 'skill'") + f" AND root_entity_type IN ('application', 'pipeline') AND root_entity_id = {AGENT} AND (run_id IS NULL OR run_id NOT IN (SELECT run_id FROM ev WHERE entity_type = 'evaluation' AND run_id IS NOT NULL))"
_SKILL_PROJECT = "CASE WHEN event_type = 'skill' AND regexp_matches(json_extract_string(meta, '$.skill_project_id'), '^[1-9][0-9]{0,8}$') THEN CAST(json_extract_string(meta, '$.skill_project_id') AS BIGINT) ELSE root_project END"
add("agent_skills", agent_skills, top_sql(f"SELECT entity_id, {_SKILL_PROJECT} AS skill_project, COUNT(*) AS events, {SQL_MEASURES['runs']} AS runs FROM ev WHERE {_AGENT_SKILLS} GROUP BY 1, 2", "events", ["entity_id", "skill_project"], 30))


def without_evaluations(s: Store) -> DataFrame:
    """Events, runs and cost of what isn't evaluation: runs are summed up in a number of tasks that grows with the events, then counted."""
    key = ["project_id", "event_type", "run_id"]
    rows = P.eval_runs_anti(s.events, s.events).select(*key, "cost_nano_usd").repartition(s.events.count() // EVENTS_A_TASK + 1, *key)
    runs = rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum("cost_nano_usd").alias("nano"))
    return runs.groupBy("project_id", "event_type").agg(F.sum("n").alias("events"), F.count("run_id").alias("runs"), F.sum("nano").alias("cost_nano"))


add("eval_runs_anti", without_evaluations, f"SELECT project_id, event_type, COUNT(*) AS events, {SQL_MEASURES['runs']} AS runs, {SQL_MEASURES['cost_nano']} AS cost_nano FROM ev WHERE run_id IS NULL OR run_id NOT IN (SELECT run_id FROM ev WHERE entity_type = 'evaluation' AND run_id IS NOT NULL) GROUP BY 1, 2")
plain("agent_runs", "agent", ["run_id"], ["started_ms", "last_ms", "active_users", "tokens", "cost_nano", "any_error"], "started_ms", 50)


def run_models(s: Store) -> DataFrame:
    rows = s.events.where(FILTERS["agent"][0]() & F.col("model_name").isNotNull())
    return rows.groupBy("run_id").agg(F.array_join(F.sort_array(F.collect_set("model_name")), ",").alias("models"))


add("run_models", run_models, f"SELECT run_id, string_agg(DISTINCT model_name, ',' ORDER BY model_name) AS models FROM ev WHERE {FILTERS['agent'][1]} AND model_name IS NOT NULL GROUP BY 1")


def one_run(s: Store) -> DataFrame:
    """Events of the agent's run that sorts first."""
    own = s.events.where((F.col("project_id") == PROJECT) & P.within(PERIOD))
    return own.join(s.events.where(FILTERS["agent"][0]()).agg(F.min("run_id").alias("run_id")), "run_id", "left_semi")


_RUN = f"project_id = {PROJECT} AND ts BETWEEN TIMESTAMP '{PERIOD.start}' AND TIMESTAMP '{PERIOD.end}' AND run_id = (SELECT MIN(run_id) FROM ev WHERE {FILTERS['agent'][1]})"
TRACE = ["idempotency_key", "event_type", "entity_type", "entity_id", "entity_name", "model_name", "tool_name", "input_tokens", "output_tokens", "cost_nano_usd", "duration_ms", "is_error"]
add("run_trace", lambda s: one_run(s).select(F.unix_millis("ts").alias("ms"), *TRACE).orderBy("ms", "idempotency_key"), f"SELECT epoch_ms(ts) AS ms, {', '.join(TRACE)} FROM ev WHERE {_RUN}")
CHAT_OF_RUNS = "00000000-0000-0000-0000-000000000007"
_SCOPES_OF = {"of_chat": ({"run": CHAT_OF_RUNS}, f"(run_id = '{CHAT_OF_RUNS}' OR conversation_id = '{CHAT_OF_RUNS}')"), "of_evaluation": ({"evaluation": 3}, "entity_type = 'evaluation' AND entity_id = 3"), "of_root": ({"root": ("application", AGENT)}, f"root_entity_type = 'application' AND root_entity_id = {AGENT}"), "of_both": ({"evaluation": 3, "root": ("pipeline", AGENT)}, f"entity_type = 'evaluation' AND entity_id = 3 AND root_entity_type = 'pipeline' AND root_entity_id = {AGENT}")}


def run_rows(s: Store) -> DataFrame:
    """The trace of all events that a scope selects, and of the agent's first run; of_ columns tell which scopes those are."""
    first = s.events.where(FILTERS["agent"][0]()).agg(F.min("run_id").alias("_first"))
    rows = s.events.crossJoin(F.broadcast(first))  # a row of one
    flags = {n: F.coalesce(P.run_filters(**own), F.lit(False)) for n, (own, _) in _SCOPES_OF.items()}
    flags["of_run"] = F.coalesce((F.col("project_id") == PROJECT) & P.within(PERIOD) & (F.col("run_id") == F.col("_first")), F.lit(False))
    selected = rows.withColumns(flags).where(" OR ".join(flags))
    return selected.select(F.unix_millis("ts").alias("ms"), *TRACE, *flags).orderBy("ms", "idempotency_key")


_FLAGS = ", ".join(f"COALESCE({where}, FALSE) AS {n}" for n, where in [*((n, where) for n, (_, where) in _SCOPES_OF.items()), ("of_run", _RUN)])
_ANY = " OR ".join([*_SCOPES_OF, "of_run"])
add("run_filters", run_rows, f"SELECT ms, {', '.join(TRACE)}, {', '.join(_SCOPES_OF)}, of_run FROM (SELECT *, epoch_ms(ts) AS ms, {_FLAGS} FROM ev) WHERE {_ANY}")
SUMMARY = ["started_ms", "last_ms", "events", "llm_calls", "tool_runs", "errors", "tokens", "cost_nano"]
add("run_summary", lambda s: one_run(s).groupBy("run_id").agg(*map(measure, SUMMARY), F.min_by("root_entity_version_id", F.struct("ts", "idempotency_key")).alias("first_version")).withColumn("duration_ms", F.col("last_ms") - F.col("started_ms")), f"SELECT *, last_ms - started_ms AS duration_ms FROM (SELECT run_id, {', '.join(f'{SQL_MEASURES[m]} AS {m}' for m in SUMMARY)}, ARG_MIN(root_entity_version_id, idempotency_key) AS first_version FROM ev WHERE {_RUN} GROUP BY 1)")
_SUB = "entity_id <> root_entity_id AND COALESCE(entity_type, '') NOT IN ('evaluation', 'skill')"
add("run_sub_agents", lambda s: s.events.where(FILTERS["agent"][0]() & (F.col("entity_id") != F.col("root_entity_id")) & ~F.coalesce("entity_type", F.lit("")).isin("evaluation", "skill")).groupBy("entity_type", "entity_id").agg(measure("events"), F.min_by("entity_name", F.struct("ts", "idempotency_key")).alias("first_name")), f"SELECT entity_type, entity_id, COUNT(*) AS events, ARG_MIN(entity_name, (ts, idempotency_key)) AS first_name FROM ev WHERE {FILTERS['agent'][1]} AND {_SUB} GROUP BY 1, 2")
EVAL = ["llm_calls", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "tokens", "cost_nano", "unpriced_calls", "unparsed_calls"]
plain("eval_run_breakdown", "model_eval", ["conversation_id", "entity_id"], EVAL)
add("run_name", lambda s: report(s.events, "agents", ["root_entity_id"], ["name", "run_row_name"]), report_sql("agents", ["root_entity_id"], ["name", "run_row_name"]))
add("event_started_at", lambda s: s.events.where(FILTERS["agent"][0]()).select("idempotency_key", F.unix_millis(C.event_started_at()).alias("started_ms")), f"SELECT idempotency_key, epoch_ms(ts - duration_ms * INTERVAL '1' MILLISECOND) AS started_ms FROM ev WHERE {FILTERS['agent'][1]}")

# --- chats
CHATS = ["runs", "llm_calls", "tool_runs", "active_users", "errors", "error_runs", "tokens", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "cost_nano", "first_ms", "last_ms", "avg_duration_ms", "models_used"]


def chats_list(s: Store) -> DataFrame:
    rows = s.events.where(FILTERS["chats"][0]()).withColumn("participant", C.participant_type())
    out = rows.groupBy("conversation_id").agg(*map(measure, CHATS), F.array_join(F.sort_array(F.collect_set("participant")), ",").alias("participants"))
    return pages.page(out, "cost_nano", ["conversation_id"], CHATS, limit=50)


_PARTICIPANT = "CASE WHEN root_entity_type IS NULL THEN 'model' WHEN root_entity_type = 'application' THEN 'agent' ELSE root_entity_type END"
add("chats_list", chats_list, top_sql(f"SELECT conversation_id, {', '.join(f'{SQL_MEASURES[m]} AS {m}' for m in CHATS)}, string_agg(DISTINCT {_PARTICIPANT}, ',' ORDER BY {_PARTICIPANT}) AS participants FROM ev WHERE {FILTERS['chats'][1]} GROUP BY 1", "cost_nano", ["conversation_id"], 50))
CHAT_KPIS = ["chats", "runs", "active_users", "llm_calls", "tokens", "cost_nano"]
add("chats_summary", lambda s: report(s.events, "chats", [], CHAT_KPIS).crossJoin(report(s.events, "model", [], ["cost_nano"]).withColumnRenamed("cost_nano", "project_nano")).withColumn("share", F.when(F.col("project_nano") > 0, F.bround(F.col("cost_nano") / F.col("project_nano"), 6))), f"SELECT *, CASE WHEN project_nano > 0 THEN round_even(cost_nano / project_nano, 6) END AS share FROM ({report_sql('chats', [], CHAT_KPIS)}) a CROSS JOIN (SELECT {SQL_MEASURES['cost_nano']} AS project_nano FROM ev WHERE {FILTERS['model'][1]}) b")
plain("chats_by_participant", "chats", ["participant"], ["chats", "runs", "tokens", "cost_nano"])


def chats_daily(s: Store) -> DataFrame:
    days = s.spark.range(1).select(F.explode(F.sequence(F.lit(PERIOD.start.date()), F.lit(PERIOD.end.date()))).alias("day")).withColumn("day", F.col("day").cast("string"))
    return days.join(report(s.events, "chats", ["day"], CHAT_KPIS), "day", "left").fillna(0)


add("chats_daily", chats_daily, f"SELECT d.day, {', '.join(f'COALESCE(t.{m}, 0) AS {m}' for m in CHAT_KPIS)} FROM (SELECT CAST(CAST(x AS DATE) AS VARCHAR) AS day FROM generate_series(DATE '{PERIOD.start.date()}', DATE '{PERIOD.end.date()}', INTERVAL 1 DAY) g(x)) d LEFT JOIN ({report_sql('chats', ['day'], CHAT_KPIS)}) t ON t.day = d.day")


def one_chat(s: Store) -> DataFrame:
    """Events of the project's chat that sorts first."""
    return s.events.join(s.events.where(FILTERS["chats"][0]()).agg(F.min("conversation_id").alias("conversation_id")), "conversation_id", "left_semi")


_CHAT = f"(SELECT * FROM ev WHERE conversation_id = (SELECT MIN(conversation_id) FROM ev WHERE {FILTERS['chats'][1]}))"
for _name, _keys, _ms in (("chat_kpis", [], CHATS), ("chat_by_participant", ["participant"], CHAT_KPIS), ("chat_by_model", ["model_name", "scope"], ["llm_calls", "tokens", "cost_nano"]), ("chat_by_user", ["user_id"], ["runs", "tokens", "cost_nano"]), ("chat_tools", ["tool_name"], ["tool_runs", "errors"]), ("chat_daily", ["day"], CHAT_KPIS), ("chat_runs", ["run_id"], ["first_ms", "last_ms", "tokens", "cost_nano", "any_error"])):
    add(_name, lambda s, k=_keys, m=_ms: report(one_chat(s), "chats", k, m), report_sql("chats", _keys, _ms, _CHAT))
add("chat_activity", chats_list, ORACLE["chats_list"].removeprefix(with_events("")))

# --- skills
SKILLS = ["events", "runs", "error_runs", "active_users", "manual_users", "llm_calls", "tool_runs", "tokens", "cost_nano", "last_ms"]
add("skill_rows", lambda s: s.events.where(FILTERS["skills"][0]()).select("idempotency_key", C.skill_id().alias("skill_id"), C.skill_project().alias("skill_project")), f"SELECT idempotency_key, {report_sql('skills', ['skill_id', 'skill_project'], ['events']).split('SELECT ')[1].split(', COUNT')[0]} FROM ev WHERE {FILTERS['skills'][1]}")
plain("skill_measures", "skills", [], SKILLS)
plain("skills_list", "skills", ["skill_id", "skill_project"], SKILLS, "runs", 20)
plain("skill_head", "skill", [], SKILLS)
for _name, _keys, _n in (("skill_daily", ["day"], 0), ("skill_by_version", ["root_entity_version_id"], 0), ("skill_by_model", ["model_name"], 0), ("skill_by_user", ["user_id"], 50), ("skill_by_trigger", ["trigger_source"], 0), ("skill_agents", ["root_entity_type", "root_entity_id"], 20), ("skill_by_source", ["source"], 0), ("skill_recent_runs", ["run_id"], 20)):
    _by = ("last_ms" if _name == "skill_recent_runs" else "events") if _n else None
    plain(_name, "skill", _keys, ["events", "runs", "tokens", "cost_nano", "last_ms"], _by, _n)

# --- buckets and projections
for _g in ("day", "week", "month"):
    plain(f"bucket_{_g}", "model", [_g], ["llm_calls", "cost_nano"])
plain("total_tokens", "all", ["project_id"], ["tokens", "events"])
plain("root_project", "all", ["root_project"], ["events"])
plain("model_scope", "all", ["scope"], ["events"])
plain("participant_type", "all", ["participant"], ["events"])
plain("skill_id", "skills", ["skill_id", "skill_project"], ["events"])
add("is_row_classes", lambda s: s.events.agg(*[F.count_if(c).alias(n) for n, c in (("agent_rows", P.is_agent_row()), ("evaluation_rows", P.is_evaluation_row()), ("skill_run_rows", P.is_skill_run_row()), ("run_rows", P.is_run_row()), ("manual_rows", P.manual_run()))]), "SELECT " + ", ".join(f"COUNT(*) FILTER (WHERE {c}) AS {n}" for n, c in (("agent_rows", "root_entity_type IN ('application', 'pipeline') AND entity_type IS DISTINCT FROM 'evaluation'"), ("evaluation_rows", "entity_type = 'evaluation'"), ("skill_run_rows", "root_entity_type = 'skill'"), ("run_rows", "entity_id = root_entity_id AND entity_type = root_entity_type"), ("manual_rows", "trigger_source IS NULL OR trigger_source IN ('chat', 'api', 'mcp')"))) + " FROM ev")
for _name, _where in (("base_filters", "base"), ("model_call_filters", "model"), ("budget_filters", "budget"), ("chat_filters", "chats")):
    plain(_name, _where, ["project_id", "event_type"], ["events", "cost_nano"])
add("read_events", lambda s: s.events.where((F.col("project_id") == PROJECT) & P.within(PERIOD)).select("idempotency_key", F.unix_millis("ts").alias("ms"), "event_type", "cost_nano_usd"), f"SELECT idempotency_key, epoch_ms(ts) AS ms, event_type, cost_nano_usd FROM ev WHERE project_id = {PROJECT} AND ts BETWEEN TIMESTAMP '{PERIOD.start}' AND TIMESTAMP '{PERIOD.end}'")
add("cache_hit_rate", lambda s: report(s.events, "model", ["model_name"], ["input_tokens", "cache_read_tokens", "cache_creation_tokens"]).select("model_name", C.cache_hit_rate(F.col("cache_read_tokens"), F.col("input_tokens"), F.col("cache_creation_tokens")).alias("hit_rate")), f"SELECT model_name, CASE WHEN input_tokens + cache_read_tokens + cache_creation_tokens > 0 THEN round_even(cache_read_tokens * 100 / (input_tokens + cache_read_tokens + cache_creation_tokens), 2) END AS hit_rate FROM ({report_sql('model', ['model_name'], ['input_tokens', 'cache_read_tokens', 'cache_creation_tokens'])})")

_SOURCE = "CASE WHEN trigger_source IN ('scheduled', 'webhook', 'schedule_manual') THEN 'automations' WHEN trigger_source = 'index' THEN 'indexing' WHEN entity_type = 'evaluation' THEN 'evaluations' WHEN root_entity_type IN ('application', 'pipeline') AND app_kind = 'pipeline' THEN 'pipelines' WHEN root_entity_type = 'pipeline' THEN 'pipelines' WHEN root_entity_type = 'application' THEN 'agents' WHEN root_entity_type = 'skill' THEN 'skills' WHEN conversation_id IS NOT NULL THEN 'chat' ELSE 'external' END"


def with_source(s: Store, rows: DataFrame) -> DataFrame:
    rows = pages.join_application(rows.withColumn("root_project", C.root_project()), s.applications)
    return rows.withColumn("spend_source", C.source_bucket(F.coalesce(F.col("kind") == "pipeline", F.lit(False))))


def spend_by_source(s: Store) -> DataFrame:
    return with_source(s, s.events.where(FILTERS["budget"][0]())).groupBy("spend_source").agg(measure("llm_calls"), measure("cost_nano"))


_BY_SOURCE = f"SELECT {_SOURCE} AS spend_source, {SQL_MEASURES['llm_calls']} AS llm_calls, {SQL_MEASURES['cost_nano']} AS cost_nano FROM {_EV_APP} WHERE {FILTERS['budget'][1]} GROUP BY 1"
add("spend_by_source", spend_by_source, _BY_SOURCE)
add("source_bucket", lambda s: with_source(s, s.events).groupBy("project_id", "event_type", "spend_source").agg(measure("events"), measure("cost_nano")), f"SELECT project_id, event_type, {_SOURCE} AS spend_source, COUNT(*) AS events, {SQL_MEASURES['cost_nano']} AS cost_nano FROM {_EV_APP} GROUP BY 1, 2, 3")
plain("spend_totals", "budget", [], ["llm_calls", "tokens", "cost_nano", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens"])
plain("spend_by_model", "budget", ["model_name"], ["llm_calls", "tokens", "cost_nano"])
plain("spend_by_day", "budget", ["day"], ["llm_calls", "tokens", "cost_nano"])
_MONTH_AGENTS = FILTERS["budget"][1] + " AND root_entity_type IN ('application', 'pipeline') AND entity_type IS DISTINCT FROM 'evaluation'"
add("top_agents", lambda s: top(s.events.where(FILTERS["budget"][0]() & P.is_agent_row()).groupBy("root_entity_id").agg(measure("cost_nano"), measure("runs")), "cost_nano", ["root_entity_id"], 5), top_sql(f"SELECT root_entity_id, {SQL_MEASURES['cost_nano']} AS cost_nano, {SQL_MEASURES['runs']} AS runs FROM ev WHERE {_MONTH_AGENTS} GROUP BY 1", "cost_nano", ["root_entity_id"], 5))
add("top_skills", lambda s: top(s.events.where(FILTERS["budget"][0]() & P.is_skill_run_row()).groupBy("root_entity_id").agg(measure("cost_nano"), measure("runs")), "runs", ["root_entity_id"], 5), top_sql(f"SELECT root_entity_id, {SQL_MEASURES['cost_nano']} AS cost_nano, {SQL_MEASURES['runs']} AS runs FROM ev WHERE {FILTERS['budget'][1]} AND root_entity_type = 'skill' GROUP BY 1", "runs", ["root_entity_id"], 5))


def daily_breakdown(s: Store) -> DataFrame:
    """Per day a map from model and one from source to nano-dollars, as sorted text."""
    rows = with_source(s, s.events.where(FILTERS["budget"][0]())).withColumn("day", F.to_date("ts").cast("string"))
    parts = [rows.groupBy("day", F.lit(kind).alias("kind"), F.col(c).alias("name")).agg(measure("cost_nano")) for kind, c in (("model", "model_name"), ("source", "spend_source"))]
    both = parts[0].unionByName(parts[1])
    entry = F.concat_ws("=", "name", F.col("cost_nano").cast("string"))
    lists = {k: F.array_join(F.sort_array(F.collect_list(F.when(F.col("kind") == k, entry))), ",") for k in ("model", "source")}
    return both.groupBy("day").agg(*[v.alias(f"by_{k}") for k, v in lists.items()])


_DAYS = f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, model_name, {_SOURCE} AS spend_source, cost_nano_usd FROM {_EV_APP} WHERE {FILTERS['budget'][1]}"
_PAIRS = " UNION ALL ".join(f"SELECT day, '{k}' AS kind, CONCAT({c}, '=', CAST(CAST(SUM(cost_nano_usd) AS BIGINT) AS VARCHAR)) AS e FROM ({_DAYS}) GROUP BY day, {c}" for k, c in (("model", "model_name"), ("source", "spend_source")))
add("daily_breakdown", daily_breakdown, f"SELECT day, string_agg(e, ',' ORDER BY e) FILTER (WHERE kind = 'model') AS by_model, string_agg(e, ',' ORDER BY e) FILTER (WHERE kind = 'source') AS by_source FROM ({_PAIRS}) GROUP BY day")


for _name, _row, _sql in (
    ("is_agent_row", P.is_agent_row, "COALESCE(root_entity_type IN ('application', 'pipeline'), FALSE) AND entity_type IS DISTINCT FROM 'evaluation'"),
    ("is_evaluation_row", P.is_evaluation_row, "entity_type IS NOT DISTINCT FROM 'evaluation'"),
    ("is_skill_run_row", P.is_skill_run_row, "root_entity_type IS NOT DISTINCT FROM 'skill'"),
    ("is_run_row", P.is_run_row, "COALESCE(entity_id = root_entity_id AND entity_type = root_entity_type, FALSE)"),
    ("manual_run", P.manual_run, "trigger_source IS NULL OR trigger_source IN ('chat', 'api', 'mcp')"),
):
    add(_name, lambda s, r=_row: s.events.groupBy("event_type", r().alias("flag")).agg(measure("events")), f"SELECT event_type, {_sql} AS flag, COUNT(*) AS events FROM ev GROUP BY 1, 2")
# the same joins over other rows: all actors, another reader, every version without a stored name
add("user_label", lambda s: pages.join_user(report(s.events, "model", ["user_id"], ["llm_calls", "stored_email"]), s.users), f"SELECT t.user_id, t.llm_calls, {_USER_LABEL} FROM ({report_sql('model', ['user_id'], ['llm_calls', 'stored_email'])}) t LEFT JOIN users u ON u.user_id = t.user_id")
add("join_conversation", lambda s: pages.join_conversation(report(s.events, "chats", ["conversation_id", "user_id"], ["runs"]), s.conversations, USER + 4), f"SELECT t.*, {_CHAT_LABEL.replace(f'<> {USER} ', f'<> {USER + 4} ')} FROM ({report_sql('chats', ['conversation_id', 'user_id'], ['runs'])}) t LEFT JOIN conversations c ON c.uuid = t.conversation_id")
add("join_version", lambda s: pages.join_version(report(s.events, "all", ["root_entity_version_id", "root_entity_type"], ["events"]), s.versions), f"SELECT t.*, COALESCE(v.version_name, CASE WHEN t.root_entity_version_id IS NOT NULL THEN CONCAT('Version #', CAST(t.root_entity_version_id AS VARCHAR)) END) AS version_label FROM ({report_sql('all', ['root_entity_version_id', 'root_entity_type'], ['events'])}) t LEFT JOIN versions v ON v.version_id = t.root_entity_version_id")
add("bucket", lambda s: s.events.where(FILTERS["model"][0]()).groupBy(C.bucket("week").alias("b")).agg(measure("events")).select(F.col("b").cast("string").alias("start"), C.bucket_end("week", F.col("b")).cast("string").alias("finish"), "events"), f"SELECT CAST(b AS VARCHAR) AS start, CAST(CAST(b + INTERVAL 7 DAY AS DATE) AS VARCHAR) AS finish, events FROM (SELECT CAST(date_trunc('week', ts) AS DATE) AS b, COUNT(*) AS events FROM ev WHERE {FILTERS['model'][1]} GROUP BY 1)")
add("period_start", lambda s: s.events.groupBy(*[C.bucket(g).cast("string").alias(g) for g in ("day", "week", "month")]).agg(measure("events")), "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week, CAST(CAST(date_trunc('month', ts) AS DATE) AS VARCHAR) AS month, COUNT(*) AS events FROM ev GROUP BY 1, 2, 3")
add("cost_usd", lambda s: report(s.events, "model", ["model_name"], ["cost_nano"]).select("model_name", C.cost_usd(F.col("cost_nano")).alias("cost_usd")), f"SELECT model_name, round_even(cost_nano / 1e9, 9) AS cost_usd FROM ({report_sql('model', ['model_name'], ['cost_nano'])})")
plain("skill_project", "skills", ["skill_project"], ["events"])


def last_week(s: Store) -> DataFrame:
    """Model calls a day in the default window, with the newest event as now."""
    now = s.events.agg(F.max("ts")).first()[0]
    period = P.date_range(None, None, now)
    return s.events.where(P.within(period)).groupBy(F.to_date("ts").cast("string").alias("day")).agg(measure("events"))


_WEEK = "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, COUNT(*) AS events FROM ev WHERE ts >= (SELECT MAX(ts) FROM ev) - INTERVAL 7 DAY GROUP BY 1"
add("date_range", last_week, _WEEK)


def year_meta(s: Store) -> DataFrame:
    """The window really used where all events were asked for: it is clamped, and counts those of its last 366 days."""
    first, last = s.events.agg(F.min("ts"), F.max("ts")).first()
    period = P.date_range(first, last, last)
    return s.events.where(P.within(period)).agg(measure("events"), F.lit(period.clamped).alias("clamped"), F.lit(len(period.defaulted)).alias("defaulted"))


add("date_range_meta", year_meta, "SELECT COUNT(*) AS events, TRUE AS clamped, 0 AS defaulted FROM ev WHERE ts >= (SELECT MAX(ts) FROM ev) - INTERVAL 366 DAY")
