"""Ingest, counter, budget and complexity operators as queries, with the SQL that must give the same rows."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterfold.functions import columns as C
from meterfold.operators import complexity as X
from meterfold.operators import counters as K
from meterfold.operators import ingest as I
from meterfold.operators.budget import best_warnings, budget_door, budget_state, scope_rows
from meterfold.operators.wire import billable_input, frame_bodies, parse_bodies, sample
from meterfold.plans.catalog import add
from meterfold.plans.parts import MONTH, PROJECT
from meterfold.schema import conform_events
from meterfold.sources import fixtures
from meterfold.sources.events import expired_months, with_month
from meterfold.scratch import scratch
from meterfold.sources.store import Store
from meterfold.streaming import rollup
from meterfold.streaming.commits import Commit, CommitLog, Run

M = MONTH.date()
TODAY = datetime.date(1997, 1, 1)

# --- ingest
add("dedupe_events", lambda s: fixtures.widened(s.first).select("idempotency_key", "arrival", "event_type", "cost_nano_usd"), "SELECT idempotency_key, arrival, event_type, cost_nano_usd FROM raw WHERE arrival = 1")
add("conform_events", lambda s: conform_events(s.raw).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("reasoning_tokens").alias("reasoning"), F.sum("cache_read_cost_nano_usd").alias("cache_cost"), F.count("role_snapshot").alias("roles"), F.sum("cost_nano_usd").alias("cost")), "SELECT event_type, COUNT(*) AS n, CAST(0 AS BIGINT) AS reasoning, CAST(SUM(cache_read_cost_nano_usd) AS BIGINT) AS cache_cost, CAST(0 AS BIGINT) AS roles, CAST(SUM(cost_nano_usd) AS BIGINT) AS cost FROM raw GROUP BY 1")


def run_ids(s: Store) -> DataFrame:
    """Orders' numbers as run ids in several spellings, and some that aren't any."""
    h = F.md5(F.col("run_id"))
    own = s.events.where("run_id IS NOT NULL").select("run_id").distinct()
    kind = F.pmod(F.regexp_extract("run_id", r"(\d+)$", 1).cast("long"), F.lit(4))
    raw = F.when(kind == 0, F.upper(h)).when(kind == 1, F.concat(F.lit("urn:uuid:"), h)).when(kind == 2, F.concat(F.lit("{"), h, F.lit("}"))).otherwise(F.col("run_id"))
    return own.select("run_id", I.canonical_run_id(raw).alias("canonical"))


_H = "md5(run_id)"
add("canonical_run_id", run_ids, f"SELECT run_id, CASE WHEN CAST(regexp_extract(run_id, '(\\d+)$', 1) AS BIGINT) % 4 < 3 THEN concat({_H}[1:8], '-', {_H}[9:12], '-', {_H}[13:16], '-', {_H}[17:20], '-', {_H}[21:32]) END AS canonical FROM (SELECT DISTINCT run_id FROM ev WHERE run_id IS NOT NULL)")


def attributions(s: Store) -> DataFrame:
    """Headers built from the events' own labels, decoded again."""
    own = s.events.where("run_id IS NOT NULL").select("idempotency_key", F.to_json(F.struct(F.md5("run_id").alias("run_id"), "conversation_id", "root_entity_type", F.col("root_entity_id").cast("string").alias("root_entity_id"), "trigger_source")).alias("json"))
    header = F.rtrim(F.translate(F.base64(F.encode("json", "UTF-8")), "+/\r\n", "-_"), F.lit("="))
    decoded = I.decode_attribution(own.select("idempotency_key", header.alias("header")))
    return decoded.select("idempotency_key", "run_id", "conversation_id", "root_entity_type", "root_entity_id", "trigger_source")


add("decode_attribution", attributions, f"SELECT idempotency_key, concat({_H}[1:8], '-', {_H}[9:12], '-', {_H}[13:16], '-', {_H}[17:20], '-', {_H}[21:32]) AS run_id, conversation_id, root_entity_type, root_entity_id, trigger_source FROM ev WHERE run_id IS NOT NULL")


def resolved(s: Store) -> DataFrame:
    calls = s.events.select("idempotency_key", "user_id", F.when(F.col("user_id") == 49, "system_user_4@service.invalid").alias("user_name"), "project_id").withColumnRenamed("project_id", "header_project")
    personal = s.users.where("user_id % 2 = 0").select("user_id", (F.col("user_id") + 100).alias("personal_project"))
    return I.resolve_project(calls, s.members, personal).select("idempotency_key", "billed_project")


add("resolve_project", resolved, "SELECT e.idempotency_key, CASE WHEN m.user_id IS NOT NULL THEN e.project_id WHEN e.user_id = 49 THEN CAST(4 AS BIGINT) WHEN e.user_id % 2 = 0 AND u.user_id IS NOT NULL THEN e.user_id + 100 END AS billed_project FROM ev e LEFT JOIN (SELECT DISTINCT project_id, user_id FROM members) m ON m.project_id = e.project_id AND m.user_id = e.user_id LEFT JOIN users u ON u.user_id = e.user_id")


#: What each of the derived bodies is, by the number of its order: a wire shape, or one that only its body tells.
BODIES = ["openai.chat", "azure.chat", "ai_dial.chat", "wam.chat", "openai.responses", "openai.embeddings", "anthropic.messages", "bedrock.converse", "bedrock.invoke", "google.generate_content", "ollama.native", "openai.chat", "anthropic.messages", "bedrock.invoke"]
ENDPOINTS = ["https://x/v1/chat/completions", "https://x/openai/deployments/d/chat/completions?api-version=1", "https://x/openai/deployments/d/chat/completions", "https://x/v1/chat/completions", "https://x/v1/responses", "https://x/v1/embeddings", "https://x/v1/messages", "https://x/model/{m}/converse-stream", "https://x/model/{m}/invoke", "https://x/v1/models/m:streamGenerateContent", "https://x/api/chat", "https://x/proxy", "https://x/proxy", "https://x/model/{m}/invoke-with-response-stream"]


def paired(s: Store) -> DataFrame:
    """Two streamed events a model call, p0 and p1, in all wire shapes by turns; the counts come late, early or twice as each shape has them."""
    names = {"m": "model_name", "i": "input_tokens", "o": "output_tokens", "r": "cache_read_tokens", "c": "cache_creation_tokens"}
    own = s.events.where("event_type = 'llm'").select("idempotency_key", *names.values())
    kind = F.pmod(F.regexp_extract("idempotency_key", r"k-(\d+)", 1).cast("long"), F.lit(len(BODIES)))

    def text(template: str) -> Column:
        return F.format_string(template.replace("%", "%%").replace("<m>", "%1$s").replace("<i>", "%2$d").replace("<o>", "%3$d").replace("<r>", "%4$d").replace("<c>", "%5$d"), *names.values())

    chat = sample("chat", t=3)
    google = sample("google", t=2)
    later = '{"choices":[]}', chat
    pairs = {
        "openai.responses": (sample("response_created"), sample("response", t=4)),
        "openai.embeddings": (sample("embeddings"), "{}"),
        "anthropic.messages": (sample("message_start"), sample("message_delta")),
        "bedrock.converse": ('{"contentBlockDelta":{}}', sample("converse")),
        "bedrock.invoke": ("{broken", sample("invoke")),
        "google.generate_content": (google, google),
        "ollama.native": ('{"model":"<m>","done":false}', sample("ollama")),
    }

    def payload(seq: int) -> Column:
        out = None
        for k, name in enumerate(BODIES):
            value = text(pairs.get(name, later)[seq])
            if k == 11:
                value = text(chat) if seq == 0 else F.lit("{}")
            if k == 13:  # packed in base64, as that stream has it
                value = F.to_json(F.struct(F.base64(F.encode(value, "UTF-8")).alias("bytes")))
            out = F.when(F.col("kind") == k, value) if out is None else out.when(F.col("kind") == k, value)
        return out

    own = own.withColumn("kind", kind)
    endpoint = F.element_at(F.array(*[F.concat_ws("", *[F.col("model_name") if part == "{m}" else F.lit(part) for part in e.partition("{m}")]) if "{m}" in e else F.lit(e) for e in ENDPOINTS]), (F.col("kind") + 1).cast("int"))
    return own.select(F.col("idempotency_key").alias("call_id"), endpoint.alias("endpoint"), F.when(F.col("kind") == 3, "wam").alias("provider"), *[payload(k).alias(f"p{k}") for k in (0, 1)])


def bodies(s: Store) -> DataFrame:
    """The events of all calls, a row each."""
    events = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("seq"), F.col(f"p{k}").alias("payload")) for k in (0, 1)]))
    return paired(s).select("call_id", "endpoint", "provider", events.alias("x")).select("call_id", "endpoint", "provider", "x.seq", "x.payload")


_KIND = f"CAST(regexp_extract(idempotency_key, 'k-(\\d+)', 1) AS BIGINT) % {len(BODIES)}"
_NAMES = "[" + ", ".join(f"'{n}'" for n in BODIES) + "]"
PARSED = f"""SELECT call_id, dialect, model_name, input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens, reasoning_tokens,
  CASE WHEN chat OR dialect IN ('openai.responses', 'google.generate_content') THEN GREATEST(0, input_tokens - cache_read_tokens - cache_creation_tokens) ELSE input_tokens END AS billable_input_tokens, 'provider' AS token_source
FROM (SELECT idempotency_key AS call_id, dialect, dialect LIKE '%.chat' AS chat, model_name, input_tokens,
  CASE dialect WHEN 'google.generate_content' THEN output_tokens + 2 WHEN 'openai.embeddings' THEN 0 ELSE output_tokens END AS output_tokens,
  CASE WHEN dialect IN ('openai.embeddings', 'ollama.native') THEN 0 ELSE cache_read_tokens END AS cache_read_tokens,
  CASE WHEN dialect IN ('openai.embeddings', 'ollama.native', 'openai.responses', 'google.generate_content') THEN 0 ELSE cache_creation_tokens END AS cache_creation_tokens,
  CAST(CASE WHEN dialect = 'google.generate_content' THEN 2 WHEN dialect = 'openai.responses' THEN 4 WHEN dialect LIKE '%.chat' THEN 3 ELSE 0 END AS BIGINT) AS reasoning_tokens
  FROM (SELECT *, ({_NAMES})[1 + {_KIND}] AS dialect FROM ev WHERE event_type = 'llm'))"""
add("parse_bodies", lambda s: parse_bodies(bodies(s)), PARSED)


def raw_bodies(s: Store) -> DataFrame:
    """The same calls as raw responses: streams of server-sent events in two styles, and lines of JSON, by turns."""
    kind = F.pmod(F.crc32("call_id"), F.lit(3))
    plain = F.concat(F.lit(": hello\n\nevent: a\ndata: "), "p0", F.lit("\n\ndata:"), "p1", F.lit("\n\ndata: [DONE]\n\n"))
    other = F.concat(F.lit("id: 1\r\ndata: "), "p0", F.lit("\r\nretry: 5\r\n\r\n\r\ndata: "), "p1", F.lit("\r\n"))
    lines = F.concat("p0", F.lit("\n\n"), "p1", F.lit("\n"))
    body = F.when(kind == 0, plain).when(kind == 1, other).otherwise(lines)
    content = F.when(kind == 0, "text/event-stream").when(kind == 2, "application/x-ndjson")
    return paired(s).select("call_id", "endpoint", "provider", content.alias("content_type"), body.alias("body"))


add("frame_bodies", lambda s: parse_bodies(frame_bodies(raw_bodies(s))), PARSED)

PROVIDERS = [None, "azure_open_ai", "ai_dial", "wam", "vertex_ai"]
DISAGREEING = ["https://gate/v1/chat/completions", "https://x/openai/deployments/d/chat/completions?api-version=1", "https://x/v1/messages", "https://x/proxy"]


def disagreeing(s: Store) -> DataFrame:
    """Calls whose provider and endpoint say different things, all with the body of a chat."""
    own = s.events.where("event_type = 'llm'")
    pick = lambda some, n: F.element_at(F.array(*[F.lit(x) for x in some]), (F.pmod(n, F.lit(len(some))) + 1).cast("int"))
    body = F.format_string(sample("chat_short", i="%d", o="%d"), "input_tokens", "output_tokens")
    rows = own.select(F.col("idempotency_key").alias("call_id"), F.lit(0).cast("long").alias("seq"), pick(DISAGREEING, F.col("duration_ms")).alias("endpoint"), pick(PROVIDERS, F.col("user_id")).alias("provider"), body.alias("payload"))
    return parse_bodies(rows).select("call_id", "dialect", "input_tokens")


add("match_provider", disagreeing, """SELECT call_id, dialect, CASE WHEN dialect <> 'anthropic.messages' THEN input_tokens END AS input_tokens FROM (
  SELECT idempotency_key AS call_id, input_tokens, CASE user_id % 5
    WHEN 0 THEN (['openai.chat', 'azure.chat', 'anthropic.messages', 'openai.chat'])[1 + duration_ms % 4] WHEN 1 THEN 'azure.chat' WHEN 2 THEN 'ai_dial.chat'
    WHEN 3 THEN (['wam.chat', 'wam.chat', 'anthropic.messages', 'openai.chat'])[1 + duration_ms % 4]
    ELSE (['openai.chat', 'azure.chat', 'anthropic.messages', 'openai.chat'])[1 + duration_ms % 4] END AS dialect FROM ev WHERE event_type = 'llm')""")
add("billable_input", lambda s: s.events.select("idempotency_key", billable_input(F.col("project_id") % 2 == 0, F.col("input_tokens"), F.col("cache_read_tokens") * 3, F.col("cache_creation_tokens")).alias("billable")), "SELECT idempotency_key, GREATEST(0, CASE WHEN project_id % 2 = 0 THEN input_tokens - 3 * cache_read_tokens - cache_creation_tokens ELSE input_tokens END) AS billable FROM ev")
PRICED = ["cost_nano_usd", "input_cost_nano_usd", "output_cost_nano_usd", "cache_read_cost_nano_usd", "cache_creation_cost_nano_usd"]
_P = {"input_cost_nano_usd": "COALESCE(billable_input_tokens * input_rate, 0)", "output_cost_nano_usd": "COALESCE(output_tokens * output_rate, 0)", "cache_read_cost_nano_usd": "COALESCE(cache_read_tokens * COALESCE(cache_read_rate, input_rate), 0)", "cache_creation_cost_nano_usd": "COALESCE(cache_creation_tokens * COALESCE(cache_creation_rate, input_rate), 0)"}
_PRICE = (
    f"SELECT idempotency_key, ev.model_name, CASE WHEN p.model_name IS NULL THEN 'unpriced' ELSE 'catalog' END AS cost_source, {' + '.join(_P.values())} AS cost_nano_usd, {', '.join(f'{v} AS {n}' for n, v in _P.items())} FROM ev LEFT JOIN prices p ON p.model_name = ev.model_name WHERE event_type = 'llm'"
)
add("price_events", lambda s: I.price_events(s.events.where("event_type = 'llm'"), s.prices).select("idempotency_key", "cost_source", *PRICED), f"SELECT idempotency_key, cost_source, {', '.join(PRICED)} FROM ({_PRICE})")
add("join_price", lambda s: I.price_events(s.events.where("event_type = 'llm'"), s.prices).groupBy("model_name", "cost_source").agg(F.count("*").alias("calls"), F.sum("cost_nano_usd").alias("cost_nano")), f"SELECT model_name, cost_source, COUNT(*) AS calls, CAST(SUM(cost_nano_usd) AS BIGINT) AS cost_nano FROM ({_PRICE}) GROUP BY 1, 2")
add("estimate_cost", lambda s: I.estimate_cost(s.events.where("event_type = 'llm'").select("idempotency_key", "model_name", (F.col("input_tokens") * 4 + 3).alias("body_bytes"), F.when(F.col("output_tokens") % 2 == 0, F.col("output_tokens")).alias("max_tokens"), F.lit(0).alias("max_completion_tokens"), F.lit(None).cast("long").alias("max_output_tokens")), s.prices, cap_nano=400_000).select("idempotency_key", "estimate_nano"), "SELECT idempotency_key, LEAST(COALESCE(input_tokens * input_rate + CASE WHEN output_tokens % 2 = 0 AND output_tokens > 0 THEN output_tokens ELSE 4096 END * output_rate, 0), 400000) AS estimate_nano FROM ev LEFT JOIN prices p ON p.model_name = ev.model_name WHERE event_type = 'llm'")


def tool_costs(s: Store) -> DataFrame:
    own = s.events.where("event_type = 'tool_cost'")
    cost = F.when(F.col("duration_ms") % 5 != 0, (F.col("duration_ms") - 300).cast("decimal(20,6)") / 1000)
    rows = own.select("ts", "idempotency_key", "project_id", F.get_json_object("meta", "$.feature").alias("feature"), F.get_json_object("meta", "$.backend").alias("backend"), F.when(F.col("duration_ms") % 7 != 0, "search").otherwise("").alias("op"), F.col("duration_ms").alias("units"), F.lit("call").alias("unit"), cost.alias("cost_usd"))
    return I.normalize_tool_cost(rows).select("idempotency_key", "valid", "model_name", "cost_nano_usd", "cost_source")


add("normalize_tool_cost", tool_costs, "SELECT idempotency_key, v AS valid, CONCAT('tavily/', CASE WHEN duration_ms % 7 <> 0 THEN 'search' ELSE '' END) AS model_name, CAST(CASE WHEN v AND duration_ms % 5 <> 0 THEN CAST(duration_ms - 300 AS BIGINT) * 1000000 ELSE 0 END AS BIGINT) AS cost_nano_usd, CASE WHEN duration_ms % 5 <> 0 THEN 'reported' ELSE 'unpriced' END AS cost_source FROM (SELECT *, duration_ms % 7 <> 0 AND (duration_ms % 5 = 0 OR duration_ms >= 300) AS v FROM ev WHERE event_type = 'tool_cost')")
_ROLES = "(SELECT project_id, user_id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM members GROUP BY 1, 2)"
add("stamp_roles", lambda s: I.stamp_roles(s.events, s.members).select("idempotency_key", F.array_join("role_snapshot", ",").alias("roles")), f"SELECT e.idempotency_key, r.roles FROM ev e LEFT JOIN {_ROLES} r ON r.project_id = e.project_id AND r.user_id = e.user_id")
add("backfill_roles", lambda s: I.backfill_roles(s.events.withColumn("role_snapshot", F.when(F.col("user_id") % 2 == 0, F.array(F.lit("old")))), s.members).select("idempotency_key", F.array_join("role_snapshot", ",").alias("roles"), "backfilled"), f"SELECT e.idempotency_key, CASE WHEN e.user_id % 2 = 0 THEN 'old' ELSE r.roles END AS roles, e.user_id % 2 <> 0 AND r.roles IS NOT NULL AS backfilled FROM ev e LEFT JOIN {_ROLES} r ON r.project_id = e.project_id AND r.user_id = e.user_id")


def filled_roles(s: Store) -> DataFrame:
    """How many events of each month get roles, where the odd users' have none, by a rewrite of these months in a commit log."""
    log = CommitLog(s.spark, scratch(s.spark, "roles"))
    own = with_month(conform_events(s.events.withColumn("role_snapshot", F.when((F.col("user_id") % 2 == 0) | (F.month("ts") % 2 == 0), F.array(F.lit("old"))))))
    commit = log.add(Commit(runs=(Run(0, 0, {"events": [log.write(rollup.by_month(own, rollup.month_counts(s.events)), "events", 0, 0, ["event_month"])]}),)))
    after, counts = rollup.fill_roles(log, commit, s.members)
    now = log.read("events", rollup.LANDED, after.runs).groupBy(F.col("event_month").cast("string").alias("event_month")).agg(F.count("*").alias("events"), F.count("role_snapshot").alias("with_roles"))
    told = s.spark.createDataFrame([*counts.items()], "event_month string, filled long")
    return now.join(told, "event_month", "left").fillna(0, ["filled"])


_LACKS = "(e.user_id % 2 <> 0 AND month(e.ts) % 2 <> 0)"
add("fill_roles", filled_roles, f"SELECT CAST(CAST(date_trunc('month', ts) AS DATE) AS VARCHAR) AS event_month, COUNT(*) AS events, COUNT(*) FILTER (WHERE NOT {_LACKS} OR r.roles IS NOT NULL) AS with_roles, COUNT(*) FILTER (WHERE {_LACKS} AND r.roles IS NOT NULL) AS filled FROM ev e LEFT JOIN {_ROLES} r ON r.project_id = e.project_id AND r.user_id = e.user_id GROUP BY 1")


def quarantined(s: Store) -> DataFrame:
    own = s.events.select("idempotency_key", "ts", F.when(F.col("duration_ms") % 11 != 0, F.col("project_id")).alias("project_id"), F.when(F.col("duration_ms") % 13 == 0, "a very long event type").otherwise(F.col("event_type")).alias("event_type"), "duration_ms")
    payload = F.when(F.col("duration_ms") % 7 == 0, "{broken").otherwise(F.to_json(F.struct("idempotency_key", "ts", "project_id", "event_type")))
    rows = own.select(F.col("idempotency_key").alias("k"), payload.alias("payload"))
    return I.quarantine_events(rows, "idempotency_key string, ts timestamp, project_id long, event_type string, _corrupt string").select("k", "reason")


add("quarantine_events", quarantined, "SELECT idempotency_key AS k, CASE WHEN duration_ms % 7 = 0 THEN 'unreadable' WHEN duration_ms % 11 = 0 THEN 'incomplete' WHEN duration_ms % 13 = 0 THEN 'too long' END AS reason FROM ev")
add("expire_partitions", lambda s: expired_months(s.events, TODAY, 90).select(F.col("event_month").cast("string").alias("event_month")), "SELECT DISTINCT CAST(CAST(date_trunc('month', ts) AS DATE) AS VARCHAR) AS event_month FROM ev WHERE date_trunc('month', ts) + INTERVAL 1 MONTH <= DATE '1997-01-01' - INTERVAL 90 DAY")
add("write_events", lambda s: s.events.groupBy(F.col("event_month").cast("string").alias("event_month")).agg(F.count("*").alias("n")), "SELECT CAST(CAST(date_trunc('month', ts) AS DATE) AS VARCHAR) AS event_month, COUNT(*) AS n FROM ev GROUP BY 1")

# --- counters
_CALLS = "SELECT project_id, user_id, CAST(date_trunc('month', ts) AS DATE) AS m, '' AS model_name, billable_input_tokens AS i, output_tokens AS o, cost_nano_usd AS c FROM ev WHERE event_type = 'llm' AND budget_exempt IS NOT TRUE UNION ALL SELECT project_id, user_id, CAST(date_trunc('month', ts) AS DATE), json_extract_string(meta, '$.feature'), 0, 0, cost_nano_usd FROM ev WHERE event_type = 'tool_cost' AND budget_exempt IS NOT TRUE"
COUNTERS = _COUNTERS = f"SELECT project_id, u AS user_id, 'month' AS period_kind, CAST(m AS VARCHAR) AS period_start, model_name, CAST(SUM(i) AS BIGINT) AS input_tokens, CAST(SUM(o) AS BIGINT) AS output_tokens, CAST(SUM(c) AS BIGINT) AS cost_nano_usd, COUNT(*) AS call_count FROM (SELECT *, 0 AS u FROM ({_CALLS}) UNION ALL SELECT *, user_id FROM ({_CALLS}) WHERE user_id <> 0) GROUP BY ALL"


def counters(s: Store) -> DataFrame:
    return K.build_counters(s.events)


def shown(df: DataFrame) -> DataFrame:
    return df.withColumn("period_start", F.col("period_start").cast("string"))


add("build_counters", lambda s: shown(counters(s)), _COUNTERS)
add("fact_totals", lambda s: shown(K.build_counters(s.events.where(F.col("event_month") == F.lit(M))).where(F.col("model_name") == "")), f"SELECT * FROM ({_COUNTERS}) WHERE period_start = '{M}' AND model_name = ''")


def stale_counters(s: Store) -> DataFrame:
    """Counters as a lagging writer would have left them: without the calls of one trigger source."""
    return K.build_counters(s.events.where(~F.col("trigger_source").eqNullSafe("webhook")))


_STALE = _COUNTERS.replace("FROM ev WHERE", "FROM ev WHERE trigger_source IS DISTINCT FROM 'webhook' AND")
_KEYS = "project_id, user_id, period_kind, period_start, model_name"
_DRIFT = f"SELECT {_KEYS}, " + ", ".join(f"COALESCE(f.{v}, 0) AS fact_{v}, COALESCE(k.{v}, 0) AS counter_{v}, COALESCE(f.{v}, 0) - COALESCE(k.{v}, 0) AS delta_{v}" for v in K.VALUES) + f" FROM ({_COUNTERS}) f FULL JOIN ({_STALE}) k USING ({_KEYS}) WHERE " + " OR ".join(f"COALESCE(f.{v}, 0) <> COALESCE(k.{v}, 0)" for v in K.VALUES)
add("counter_drift", lambda s: shown(K.counter_drift(counters(s), stale_counters(s))), _DRIFT)
add("drift_join", lambda s: shown(K.counter_drift(stale_counters(s), counters(s)).groupBy("project_id", "period_start").agg(F.count("*").alias("keys"), F.sum((F.col("fact_call_count") == 0).cast("long")).alias("missing"), F.sum("delta_cost_nano_usd").alias("delta_nano"))), f"SELECT project_id, period_start, COUNT(*) AS keys, COUNT(*) FILTER (WHERE counter_call_count = 0) AS missing, CAST(-SUM(delta_cost_nano_usd) AS BIGINT) AS delta_nano FROM ({_DRIFT}) GROUP BY 1, 2")
add("counter_totals", lambda s: shown(stale_counters(s).where(F.col("model_name") == "")), f"SELECT * FROM ({_STALE}) WHERE model_name = ''")
add("counter_repair", lambda s: shown(K.counter_repair(stale_counters(s), K.counter_drift(counters(s), stale_counters(s)))), _COUNTERS)


def history(s: Store) -> DataFrame:
    """Days as runs of the reconciler, the last of them added to the others."""
    days = s.events.groupBy(F.to_date("ts").cast("string").alias("ran_at")).agg(F.count("*").alias("checked"))
    last = days.agg(F.max("ran_at").alias("ran_at"))
    return K.reconcile_history(days.join(last, "ran_at", "left_anti"), days.join(last, "ran_at", "left_semi"))


add("reconcile_history", history, "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS ran_at, COUNT(*) AS checked FROM ev GROUP BY 1 ORDER BY 1 DESC LIMIT 168")

# --- spend and budget
_MINE = f"FROM ({_COUNTERS}) WHERE project_id = {PROJECT} AND period_start = '{M}'"


def month_counters(s: Store) -> DataFrame:
    """The month's counters, from its part of the stored table."""
    return s.counters.where(F.col("period_start") == F.lit(M))


def spend(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in K.VALUES])


_SUMS = ", ".join(f"CAST(COALESCE(SUM({v}), 0) AS BIGINT) AS {v}" for v in K.VALUES)
add("project_spend", lambda s: spend(month_counters(s).where(f"project_id = {PROJECT} AND user_id = 0 AND model_name = ''")), f"SELECT {_SUMS} {_MINE} AND user_id = 0 AND model_name = ''")
add("user_spend", lambda s: spend(month_counters(s).where(f"project_id = {PROJECT} AND user_id = 7 AND model_name = ''")), f"SELECT {_SUMS} {_MINE} AND user_id = 7 AND model_name = ''")
add("projects_spend", lambda s: s.limits.select("project_id").unionByName(s.limits.select((F.col("project_id") + 100).alias("project_id"))).join(month_counters(s).where("user_id = 0 AND model_name = ''").select("project_id", "cost_nano_usd"), "project_id", "left").fillna(0), f"SELECT l.project_id, COALESCE(c.cost_nano_usd, 0) AS cost_nano_usd FROM (SELECT project_id FROM limits UNION ALL SELECT project_id + 100 FROM limits) l LEFT JOIN (SELECT * FROM ({_COUNTERS}) WHERE user_id = 0 AND model_name = '' AND period_start = '{M}') c ON c.project_id = l.project_id")
add("users_spend", lambda s: s.users.select("user_id").join(month_counters(s).where(f"project_id = {PROJECT} AND user_id <> 0 AND model_name = ''").select("user_id", "cost_nano_usd"), "user_id", "left").fillna(0), f"SELECT u.user_id, COALESCE(c.cost_nano_usd, 0) AS cost_nano_usd FROM users u LEFT JOIN (SELECT * {_MINE} AND model_name = '') c ON c.user_id = u.user_id")
add("member_spend", lambda s: month_counters(s).where(f"project_id = {PROJECT} AND model_name = ''").select(F.when(F.col("user_id") == 0, "project").otherwise("member").alias("kind"), "user_id", "cost_nano_usd", "call_count"), f"SELECT CASE WHEN user_id = 0 THEN 'project' ELSE 'member' END AS kind, user_id, cost_nano_usd, call_count {_MINE} AND model_name = ''")
add("feature_spend", lambda s: month_counters(s).where(f"project_id = {PROJECT} AND model_name = 'web_search'").agg(F.sum(F.when(F.col("user_id") == 0, F.col("cost_nano_usd"))).alias("project_nano"), F.sum(F.when(F.col("user_id") == 7, F.col("cost_nano_usd"))).alias("member_nano"), F.sum(F.when(F.col("user_id") == 0, F.col("call_count"))).alias("calls")), f"SELECT CAST(SUM(cost_nano_usd) FILTER (WHERE user_id = 0) AS BIGINT) AS project_nano, CAST(SUM(cost_nano_usd) FILTER (WHERE user_id = 7) AS BIGINT) AS member_nano, CAST(SUM(call_count) FILTER (WHERE user_id = 0) AS BIGINT) AS calls {_MINE} AND model_name = 'web_search'")
add("available_periods", lambda s: s.counters.where(f"project_id = {PROJECT}").select(F.date_format("period_start", "yyyyMM").alias("period")).unionByName(s.spark.range(1).select(F.lit("200112").alias("period"))).distinct().orderBy(F.col("period").desc()).limit(24), f"SELECT period FROM (SELECT strftime(CAST(period_start AS DATE), '%Y%m') AS period FROM ({_COUNTERS}) WHERE project_id = {PROJECT} UNION SELECT '200112') ORDER BY 1 DESC LIMIT 24")


def monthly_history(s: Store) -> DataFrame:
    months = s.spark.range(1).select(F.explode(F.sequence(F.add_months(F.lit(TODAY), -12), F.add_months(F.lit(TODAY), -1), F.expr("INTERVAL 1 MONTH"))).alias("period_start"))
    own = s.counters.where(f"project_id = {PROJECT} AND user_id = 0 AND model_name = ''").select("period_start", "cost_nano_usd", "call_count")
    return shown(months.join(own, "period_start", "left").fillna(0))


add("monthly_history", monthly_history, f"SELECT CAST(CAST(x AS DATE) AS VARCHAR) AS period_start, COALESCE(cost_nano_usd, 0) AS cost_nano_usd, COALESCE(call_count, 0) AS call_count FROM generate_series(DATE '1996-01-01', DATE '1996-12-01', INTERVAL 1 MONTH) g(x) LEFT JOIN (SELECT * FROM ({_COUNTERS}) WHERE project_id = {PROJECT} AND user_id = 0 AND model_name = '') c ON c.period_start = CAST(CAST(x AS DATE) AS VARCHAR)")


def all_scopes(s: Store) -> DataFrame:
    return scope_rows(month_counters(s), s.limits)


_SCOPES = f"SELECT c.project_id, c.user_id, CASE WHEN c.user_id = 0 THEN 'project' ELSE 'member' END AS scope, c.cost_nano_usd AS spent_nano, CASE WHEN c.user_id = 0 THEN l.project_limit_nano ELSE l.member_limit_nano END AS limit_nano, l.enabled, CASE WHEN l.is_personal THEN 60 ELSE 75 END AS threshold FROM ({_COUNTERS}) c JOIN limits l ON l.project_id = c.project_id WHERE c.period_start = '{M}' AND c.model_name = ''"
_USED = "spent_nano * 100 / limit_nano"
_LEVEL = f"CASE WHEN limit_nano > 0 AND {_USED} >= threshold AND {_USED} < 100 THEN GREATEST(threshold, CASE WHEN {_USED} >= 95 THEN 95 WHEN {_USED} >= 90 THEN 90 ELSE 0 END) END"
add("budget_percent", lambda s: budget_state(all_scopes(s)).groupBy("scope").agg(F.max("percent").alias("most"), F.sum((F.col("percent") >= 100).cast("long")).alias("over"), F.sum(F.col("percent").isNull().cast("long")).alias("unlimited")), f"SELECT scope, MAX(percent) AS most, CAST(SUM(CASE WHEN percent >= 100 THEN 1 WHEN percent < 100 THEN 0 END) AS BIGINT) AS over, COUNT(*) FILTER (WHERE percent IS NULL) AS unlimited FROM (SELECT scope, CASE WHEN limit_nano > 0 THEN round_even({_USED}, 2) END AS percent FROM ({_SCOPES})) GROUP BY 1")
for _name in ("budget_state", "redact_amounts"):
    _hide = _name == "redact_amounts"
    _money = "" if _hide else "spent_nano, limit_nano, CASE WHEN limit_nano IS NOT NULL THEN GREATEST(0, limit_nano - spent_nano) END AS remaining_nano, "
    add(_name, lambda s, h=_hide: C.redact_amounts(budget_state(all_scopes(s)).withColumnRenamed("spent_nano", "spent_nano_cost" if h else "spent_nano"), not h), f"SELECT project_id, user_id, scope, {_money}CASE WHEN limit_nano > 0 THEN round_even({_USED}, 2) END AS percent FROM ({_SCOPES})")
add("warning_level", lambda s: all_scopes(s).select("project_id", "user_id", "scope", C.warning_level(F.col("spent_nano"), F.col("limit_nano"), F.col("threshold")).alias("level")), f"SELECT project_id, user_id, scope, {_LEVEL} AS level FROM ({_SCOPES})")
_WARN = f"SELECT project_id, m.user_id AS member_id, ARG_MAX(scope, level * 2 + CASE WHEN scope = 'member' THEN 1 ELSE 0 END) AS scope, MAX(level) AS level FROM (SELECT *, {_LEVEL} AS level FROM ({{scopes}}) WHERE enabled) x JOIN (SELECT DISTINCT project_id AS mp, user_id FROM members) m ON m.mp = x.project_id AND (x.user_id = 0 OR x.user_id = m.user_id) WHERE level IS NOT NULL GROUP BY 1, 2"
add("budget_warnings", lambda s: best_warnings(all_scopes(s), s.members), _WARN.format(scopes=_SCOPES))
_FEATURE = _SCOPES.replace("c.model_name = ''", "c.model_name = 'web_search'").replace("l.project_limit_nano ELSE l.member_limit_nano END", "l.project_limit_nano // 6 ELSE l.member_limit_nano // 6 END")


def feature_limits(s: Store) -> DataFrame:
    return s.limits.withColumn("project_limit_nano", F.floor(F.col("project_limit_nano") / 6)).withColumn("member_limit_nano", F.floor(F.col("member_limit_nano") / 6))


add("feature_warnings", lambda s: best_warnings(scope_rows(month_counters(s), feature_limits(s), "web_search"), s.members), _WARN.format(scopes=_FEATURE))
add("budget_door", lambda s: budget_door(all_scopes(s), s.members), f"SELECT m.project_id, m.user_id AS member_id, CASE WHEN MAX(CASE WHEN scope = 'project' AND spent_nano >= limit_nano THEN 1 ELSE 0 END) = 1 THEN 'project' WHEN MAX(CASE WHEN scope = 'member' AND spent_nano >= limit_nano THEN 1 ELSE 0 END) = 1 THEN 'member' END AS closed_by FROM (SELECT DISTINCT project_id, user_id FROM members) m LEFT JOIN (SELECT * FROM ({_SCOPES}) WHERE enabled) x ON x.project_id = m.project_id AND (x.user_id = 0 OR x.user_id = m.user_id) GROUP BY 1, 2")
_SPENT = "SELECT project_id, {user} AS user_id, CAST(date_trunc('month', ts) AS DATE) AS p, ts, idempotency_key, SUM(cost_nano_usd) OVER (PARTITION BY project_id, {user}, date_trunc('month', ts) ORDER BY ts, idempotency_key ROWS UNBOUNDED PRECEDING) AS running FROM ev WHERE event_type = 'llm' AND budget_exempt IS NOT TRUE"
_RUNNING = _SPENT.format(user="CAST(0 AS BIGINT)")
_MEMBERS = _SPENT.format(user="user_id") + " AND user_id <> 0"


def breaches(s: Store) -> DataFrame:
    tight = s.limits.withColumn("project_limit_nano", F.floor(F.col("project_limit_nano") / 3)).withColumn("member_limit_nano", F.floor(F.col("member_limit_nano") / 3))
    return K.budget_breach(s.events, tight).select("project_id", "user_id", F.col("period_start").cast("string").alias("period_start"), "running_nano")


add("budget_breach", breaches, f"SELECT r.project_id, r.user_id, CAST(p AS VARCHAR) AS period_start, CAST(MIN(running) AS BIGINT) AS running_nano FROM ({_RUNNING} UNION ALL {_MEMBERS}) r JOIN limits l ON l.project_id = r.project_id WHERE running > CASE WHEN r.user_id = 0 THEN l.project_limit_nano ELSE l.member_limit_nano END // 3 GROUP BY 1, 2, 3")

# --- complexity
START, END = datetime.datetime(1996, 3, 1), datetime.datetime(1996, 12, 31)


def runs(s: Store) -> DataFrame:
    return X.run_rows(X.by_run(s.events), X.window_runs(s.events, START, END))


_RUNS = f"(SELECT * FROM ev WHERE (project_id, run_id) IN (SELECT project_id, run_id FROM ev WHERE ts > TIMESTAMP '{START}' AND ts <= TIMESTAMP '{END}'))"
_CALL = "event_type = 'llm' AND NOT is_error"
_AGG = f"SELECT project_id, run_id, MIN(ts) AS first_ts, MAX(ts) AS last_ts, COALESCE(MAX(CASE WHEN {_CALL} THEN input_tokens END), 0) AS peak_input_tokens, COUNT(*) FILTER (WHERE {_CALL}) AS llm_calls, COUNT(*) FILTER (WHERE event_type = 'tool') AS tool_calls, MAX(root_entity_type) AS root_entity_type, MAX(root_entity_id) AS root_entity_id, MAX(root_entity_version_id) AS root_entity_version_id, MAX(conversation_id) AS conversation_id FROM {_RUNS} GROUP BY 1, 2"
add("window_runs", lambda s: X.window_runs(s.events, START, END), f"SELECT DISTINCT project_id, run_id FROM ev WHERE run_id IS NOT NULL AND ts > TIMESTAMP '{START}' AND ts <= TIMESTAMP '{END}'")
add("run_rows", lambda s: runs(s).select("idempotency_key", "run_id"), f"SELECT idempotency_key, run_id FROM {_RUNS}")
add("run_aggregates", lambda s: X.run_aggregates(runs(s)).select("project_id", "run_id", F.unix_millis("ts").alias("first_ms"), F.unix_millis("last_event_at").alias("last_ms"), "peak_input_tokens", "llm_calls", "tool_calls"), f"SELECT project_id, run_id, epoch_ms(first_ts) AS first_ms, epoch_ms(last_ts) AS last_ms, peak_input_tokens, llm_calls, tool_calls FROM ({_AGG})")
_COUNTS = f"SELECT project_id, run_id, tool_name, json_extract_string(meta, '$.toolkit_type') AS toolkit_type, COUNT(*) AS calls FROM {_RUNS} WHERE event_type = 'tool' GROUP BY 1, 2, 3, 4"
add("run_tool_counts", lambda s: X.run_tool_counts(runs(s)), _COUNTS)
_WEIGHTED = f"SELECT t.*, COALESCE(a.weight, b.weight, 1) AS weight FROM ({_COUNTS}) t LEFT JOIN tool_weights a ON a.tool = CONCAT(t.toolkit_type, ':', list_last(string_split(t.tool_name, '__'))) AND t.toolkit_type IS NOT NULL LEFT JOIN tool_weights b ON b.tool = list_last(string_split(t.tool_name, '__'))"
add("join_weights", lambda s: X.tool_weights(X.run_tool_counts(runs(s)), s.tool_weights), _WEIGHTED)
_ALL_WEIGHTED = _WEIGHTED.replace(_RUNS, "ev").replace("b.weight, 1)", "b.weight, 3)")
add("tool_weight", lambda s: X.tool_weights(X.run_tool_counts(s.events), s.tool_weights, default=3), _ALL_WEIGHTED)


def score_log(s: Store) -> CommitLog:
    """Scores of the window's runs and their rollup, stored once and read by every report."""

    def build(path: str) -> None:
        rollup.keep_scores(CommitLog(s.spark, path), Commit(), X.score_runs(X.run_aggregates(runs(s)), X.run_tool_counts(runs(s)), s.tool_weights, END), "month")

    return CommitLog(s.spark, s.built("scores", build))


def scored(s: Store) -> DataFrame:
    return rollup.read_scores(score_log(s))


_SCORED = f"SELECT *, cu_context + cu_llm + cu_tools AS cu_total, first_ts AS ts FROM (SELECT r.*, LEAST(peak_input_tokens / 1000.0, 30.0)::DOUBLE AS cu_context, CAST(llm_calls AS DOUBLE) AS cu_llm, CAST(COALESCE(w.n, 0) AS DOUBLE) AS cu_tools FROM ({_AGG}) r LEFT JOIN (SELECT project_id, run_id, SUM(weight * calls) AS n FROM ({_WEIGHTED}) GROUP BY 1, 2) w ON w.project_id = r.project_id AND w.run_id = r.run_id WHERE llm_calls + tool_calls > 0 AND last_ts <= TIMESTAMP '{END}')"
add("score_runs", lambda s: scored(s).select("project_id", "run_id", "cu_context", "cu_llm", "cu_tools", "cu_total"), f"SELECT project_id, run_id, cu_context, cu_llm, cu_tools, cu_total FROM ({_SCORED})")
SCORED_ALL = _SCORED.replace(_RUNS, "(SELECT * FROM ev WHERE run_id IS NOT NULL)").replace(f" AND last_ts <= TIMESTAMP '{END}'", "")
_EDGES = [0.0, *X.BOUNDS, 1e18]
_HIST = ", ".join(f"COUNT(*) FILTER (WHERE cu_total >= {a} AND cu_total < {b}) AS h{k}" for k, (a, b) in enumerate(zip(_EDGES, _EDGES[1:], strict=False)))
_DAILYC = f"SELECT project_id, root_entity_type, root_entity_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, COUNT(*) AS runs, SUM(cu_total) AS cu_sum, MAX(cu_total) AS cu_max, {_HIST} FROM ({_SCORED}) WHERE root_entity_id IS NOT NULL GROUP BY 1, 2, 3, 4"
N = len(X.BOUNDS) + 1


def daily(s: Store) -> DataFrame:
    return rollup.read_daily(score_log(s)).drop("part")


def late_lines(s: Store) -> DataFrame:
    """The events with those of later lines a day earlier, so that they move their runs' first day."""
    line = F.regexp_extract("idempotency_key", r"-(\d+)$", 1).cast("int")
    return s.events.where("run_id IS NOT NULL").withColumn("late", line >= 6).withColumn("ts", F.when(F.col("late"), F.col("ts") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts")))


def score_all(s: Store, rows: DataFrame) -> DataFrame:
    return X.score_runs(X.run_aggregates(rows), X.run_tool_counts(rows), s.tool_weights)


def two_passes(s: Store) -> tuple[CommitLog, DataFrame]:
    """A log in which all runs are scored, then those again that late events change; and the keys that these touch."""
    rows = X.by_run(late_lines(s))
    log = CommitLog(s.spark, scratch(s.spark, "two-passes"))
    first = rollup.keep_scores(log, Commit(), score_all(s, rows.where("NOT late")), "month")
    late = rows.where("late").select("project_id", "run_id").distinct()
    again = X.run_rows(rows, late)
    rollup.keep_scores(log, first, score_all(s, again), "month")
    changed = rollup.read_scores(log).join(late, ["project_id", "run_id"], "left_semi")
    return log, rollup.daily_keys(changed, rollup.read_scores(log, first))


_LATE_EV = "(SELECT * REPLACE (CASE WHEN late THEN ts - INTERVAL 1 DAY ELSE ts END AS ts) FROM (SELECT *, CAST(regexp_extract(idempotency_key, '-(\\d+)$', 1) AS INT) >= 6 AS late FROM ev WHERE run_id IS NOT NULL))"


def flat(df: DataFrame) -> DataFrame:
    return df.withColumns({f"h{k}": F.col("histogram")[k] for k in range(N)}).drop("histogram")


_LATE_ALL = SCORED_ALL.replace("(SELECT * FROM ev WHERE run_id IS NOT NULL)", _LATE_EV)
_LATE_FIRST = SCORED_ALL.replace("(SELECT * FROM ev WHERE run_id IS NOT NULL)", f"(SELECT * FROM {_LATE_EV} WHERE NOT late)")
add("daily_rollup", lambda s: flat(rollup.read_daily(two_passes(s)[0]).drop("part")).withColumn("day", F.col("day").cast("string")), _DAILYC.replace(_SCORED, _LATE_ALL))
add("complexity_daily", lambda s: flat(daily(s)).withColumn("day", F.col("day").cast("string")), _DAILYC)
_KEYS_OF = "SELECT project_id, root_entity_type, root_entity_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM ({}) WHERE root_entity_id IS NOT NULL AND (project_id, run_id) IN (SELECT project_id, run_id FROM {} WHERE late)"
add("daily_keys", lambda s: two_passes(s)[1].withColumn("day", F.col("day").cast("string")), f"{_KEYS_OF.format(_LATE_ALL, _LATE_EV)} UNION {_KEYS_OF.format(_LATE_FIRST, _LATE_EV)}")
add("expire_daily", lambda s: flat(X.expire_daily(daily(s), TODAY, 3)).select("root_entity_id", F.col("day").cast("string").alias("day"), "runs"), f"SELECT root_entity_id, day, runs FROM ({_DAILYC}) WHERE day >= '1996-10-01'")
_ENT = f"SELECT project_id, root_entity_type, root_entity_id, CAST(SUM(runs) AS BIGINT) AS runs, SUM(cu_sum) AS cu_sum, MAX(cu_max) AS cu_max, {', '.join(f'CAST(SUM(h{k}) AS BIGINT) AS h{k}' for k in range(N))} FROM ({_DAILYC}) GROUP BY 1, 2, 3"
_BEFORE = [" + ".join(["0", *[f"h{j}" for j in range(k)]]) for k in range(N + 1)]
_MEDIAN = "CASE WHEN runs <= 2 THEN cu_sum / runs " + " ".join(f"WHEN ({_BEFORE[k + 1]}) * 2 >= runs THEN {_EDGES[k]}::DOUBLE + (LEAST({_EDGES[k + 1] if k + 1 < N else 'cu_max'}, GREATEST(cu_max, {_EDGES[k]})) - {_EDGES[k]})::DOUBLE * (runs / 2.0::DOUBLE - ({_BEFORE[k]})) / h{k}" for k in range(N)) + " END"
_ENTS = f"SELECT *, {_MEDIAN} AS cu_median, cu_sum / runs AS cu_avg FROM ({_ENT})"
ENT = ["project_id", "root_entity_type", "root_entity_id", "runs", "cu_sum", "cu_max", "cu_median", "cu_avg"]
add("median_lateral", lambda s: daily(s).select("project_id", "root_entity_type", "root_entity_id", F.col("day").cast("string").alias("day"), X.histogram_median(F.col("histogram"), F.col("runs"), F.col("cu_sum"), F.col("cu_max")).alias("cu_median")), f"SELECT project_id, root_entity_type, root_entity_id, day, {_MEDIAN} AS cu_median FROM ({_DAILYC})")
add("complexity_entities", lambda s: X.complexity_entities(daily(s)).select(*ENT), f"SELECT {', '.join(ENT)} FROM ({_ENTS})")
_EXACT = f"SELECT project_id, root_entity_type, root_entity_id, COUNT(*) AS n, MAX(cu_total) AS mx, quantile_cont(cu_total, 0.5) AS md FROM ({_SCORED}) WHERE root_entity_id IS NOT NULL AND ts >= TIMESTAMP '1996-05-01' GROUP BY 1, 2, 3"
add("complexity_summary", lambda s: X.complexity_summary(X.complexity_entities(daily(s)), scored(s).where(F.col("ts") >= F.lit(datetime.datetime(1996, 5, 1)))), f"SELECT r.project_id, r.root_entity_type, r.root_entity_id, CASE WHEN n >= runs THEN n ELSE runs END AS runs, CASE WHEN n >= runs THEN mx ELSE cu_max END AS cu_max, CASE WHEN n >= runs THEN md ELSE cu_median END AS cu_median, COALESCE(n >= runs, FALSE) AS exact FROM ({_ENTS}) r LEFT JOIN ({_EXACT}) e ON e.project_id = r.project_id AND e.root_entity_type = r.root_entity_type AND e.root_entity_id = r.root_entity_id")
add("complexity_trend", lambda s: daily(s).where(f"project_id = {PROJECT}").groupBy(F.col("day").cast("string").alias("day")).agg(F.sum("runs").alias("runs"), F.sum("cu_sum").alias("cu_sum"), F.max("cu_max").alias("cu_max")), f"SELECT day, CAST(SUM(runs) AS BIGINT) AS runs, SUM(cu_sum) AS cu_sum, MAX(cu_max) AS cu_max FROM ({_DAILYC}) WHERE project_id = {PROJECT} GROUP BY 1")
add("complexity_versions", lambda s: X.complexity_versions(scored(s).where(f"project_id = {PROJECT}")), f"SELECT root_entity_id, root_entity_version_id, COUNT(*) AS runs, quantile_cont(cu_total, 0.5) AS cu_median FROM ({_SCORED}) WHERE project_id = {PROJECT} GROUP BY 1, 2")
add("complexity_runs", lambda s: scored(s).where(f"project_id = {PROJECT}").orderBy(F.col("cu_total").desc(), "run_id").limit(20).select("run_id", "cu_total"), f"SELECT run_id, cu_total FROM ({_SCORED}) WHERE project_id = {PROJECT} ORDER BY cu_total DESC, run_id LIMIT 20")
add("conversation_top_run", lambda s: X.conversation_top_run(scored(s)).select("conversation_id", "run_id", "cu_total"), f"SELECT conversation_id, run_id, cu_total FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conversation_id ORDER BY cu_total DESC, ts DESC, run_id) AS rn FROM ({_SCORED}) WHERE conversation_id IS NOT NULL) WHERE rn = 1")
_NEW = f"SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY project_id, root_entity_type, root_entity_id ORDER BY ts DESC, run_id) AS rn FROM ({_SCORED}) WHERE root_entity_id IS NOT NULL AND ts >= DATE '1996-12-02' AND ts < DATE '1997-01-01') WHERE rn <= 50"
_CAL = f"SELECT COUNT(*) AS sample_runs, COUNT(DISTINCT (project_id, root_entity_type, root_entity_id)) AS sample_entities, quantile_cont(cu_total, 0.75) AS p75, quantile_cont(cu_total, 0.9) AS p90, quantile_cont(cu_total, 0.99) AS p99 FROM ({_NEW})"
add("calibrate", lambda s: X.calibrate(scored(s), TODAY).drop("breakpoints"), _CAL)
_RISES = "sample_runs >= 20 AND sample_entities >= 10 AND round_even(p75, 1) > 0 AND round_even(p75, 1) < round_even(p90, 1) AND round_even(p90, 1) < round_even(p99, 1)"
_THRESHOLDS = f"SELECT CASE WHEN {_RISES} THEN round_even(p75, 1) ELSE 10.0 END AS medium, CASE WHEN {_RISES} THEN round_even(p90, 1) ELSE 25.0 END AS high, CASE WHEN {_RISES} THEN round_even(p99, 1) ELSE 60.0 END AS extreme, CASE WHEN {_RISES} THEN 'calibrated' ELSE 'default' END AS source FROM ({_CAL})"


def thresholds(s: Store) -> DataFrame:
    return X.resolve_thresholds(X.calibrate(scored(s), TODAY), X.Calibration(min_runs=20))


add("resolve_thresholds", thresholds, _THRESHOLDS)
add("cu_label", lambda s: scored(s).crossJoin(F.broadcast(thresholds(s))).select("project_id", "run_id", C.cu_label(F.col("cu_total"), F.col("medium"), F.col("high"), F.col("extreme")).alias("label")), f"SELECT project_id, run_id, CASE WHEN cu_total >= extreme THEN 'X' WHEN cu_total >= high THEN 'H' WHEN cu_total >= medium THEN 'M' ELSE 'L' END AS label FROM ({_SCORED}) CROSS JOIN ({_THRESHOLDS})")
add("percentile_of", lambda s: scored(s).crossJoin(F.broadcast(X.calibrate(scored(s), TODAY).select("breakpoints"))).select("project_id", "run_id", C.percentile_of(F.col("cu_total"), F.col("breakpoints")).cast("int").alias("percentile")), f"SELECT project_id, run_id, CAST(len(list_filter(b, lambda x: x <= cu_total)) AS INTEGER) AS percentile FROM ({_SCORED}) CROSS JOIN (SELECT quantile_cont(cu_total, [{', '.join(str(k / 100) for k in range(1, 100))}]) AS b FROM ({_NEW}))")
add("complexity_freshness", lambda s: X.complexity_freshness(s.events.groupBy("project_id").agg(F.max("ts").alias("computed_at")), datetime.datetime(2002, 1, 1)).select("project_id", "stale"), "SELECT project_id, MAX(ts) < TIMESTAMP '2002-01-01' - INTERVAL 26 HOUR AS stale FROM ev GROUP BY 1")
add("running_spend", lambda s: K.running_spend(s.events.where((F.col("event_month") == F.lit(M)) & (F.col("project_id") == PROJECT))).select("idempotency_key", "running_nano"), f"SELECT idempotency_key, CAST(running AS BIGINT) AS running_nano FROM ({_RUNNING}) WHERE project_id = {PROJECT} AND p = DATE '{M}'")
