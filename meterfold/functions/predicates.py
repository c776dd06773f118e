"""Which events a report reads. Bounds of analytics reports are inclusive, those of spend reports half-open."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Event types and trigger sources as they are recorded.
AGENT_TYPES = ("application", "pipeline")
MANUAL_SOURCES = ("chat", "api", "mcp")
AUTOMATION_SOURCES = ("scheduled", "webhook", "schedule_manual")
#: Patterns of the addresses of service accounts, where a caller names no others; their domain is a deployment's own.
SERVICE_EMAILS = ("system@service.invalid", "system_user_%@service.invalid")
CHAT_LIKE = "________-____-____-____-____________"
DEFAULT_DAYS, MAX_DAYS = 7, 366


@dataclass(frozen=True)
class Period:
    start: datetime.datetime
    end: datetime.datetime
    defaulted: tuple[str, ...] = ()
    clamped: bool = False


def date_range(start: datetime.datetime | None, end: datetime.datetime | None, now: datetime.datetime) -> Period:
    """The window to report on: the last week by default; one bound sets the other; more than 366 days lose their beginning."""
    if start and end and start > end:
        raise ValueError("the start is after the end")
    defaulted = tuple(n for n, v in (("from", start), ("to", end)) if v is None)
    week = datetime.timedelta(days=DEFAULT_DAYS)
    end = end or (min(start + week, now) if start else now)
    start = start or end - week
    longest = datetime.timedelta(days=MAX_DAYS)
    clamped = end - start > longest
    return Period(end - longest if clamped else start, end, defaulted, clamped)


def within(p: Period) -> Column:
    """Inclusive bounds on ts, and on the months that the table is partitioned by."""
    months = F.col("event_month").between(F.lit(p.start.date().replace(day=1)), F.lit(p.end.date().replace(day=1)))
    return months & F.col("ts").between(F.lit(p.start), F.lit(p.end))


def since(start: datetime.datetime, end: datetime.datetime) -> Column:
    """Half-open bounds."""
    months = F.col("event_month").between(F.lit(start.date().replace(day=1)), F.lit(end.date().replace(day=1)))
    return months & (F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end))


def human(services: tuple[str, ...] = SERVICE_EMAILS) -> Column:
    """Events of people: neither of actor 0 nor of an address that one of the patterns fits; an unknown address counts as a person's."""
    email, service = F.col("user_email"), F.lit(False)
    for pattern in services:
        service = service | email.like(pattern)
    return (F.col("user_id") != 0) & (email.isNull() | ~service)


def base_filters(project: int, p: Period, types: tuple[str, ...] = ("llm", "tool"), services: tuple[str, ...] = SERVICE_EMAILS) -> Column:
    return (F.col("project_id") == project) & F.col("event_type").isin(*types) & within(p) & human(services)


def model_call_filters(project: int, p: Period) -> Column:
    return (F.col("project_id") == project) & (F.col("event_type") == "llm") & within(p)


def counted() -> Column:
    return ~F.col("budget_exempt").eqNullSafe(True)


def budget_filters(project: int, start: datetime.datetime, end: datetime.datetime, user: int | None = None) -> Column:
    own = (F.col("project_id") == project) & (F.col("event_type") == "llm") & since(start, end) & counted()
    return own if user is None else own & (F.col("user_id") == user)


def run_filters(run: str | None = None, evaluation: int | None = None, root: tuple[str, int] | None = None) -> Column:
    """Events of a run or conversation, of an evaluation, of a root entity."""
    out = F.lit(True)
    if run is not None:
        out = out & ((F.col("run_id") == run) | (F.col("conversation_id") == run))
    if evaluation is not None:
        out = out & (F.col("entity_type") == "evaluation") & (F.col("entity_id") == evaluation)
    if root is not None:
        out = out & (F.col("root_entity_type") == root[0]) & (F.col("root_entity_id") == root[1])
    return out


def chat_filters(project: int, p: Period) -> Column:
    return base_filters(project, p) & F.col("conversation_id").like(CHAT_LIKE)


def is_evaluation_row() -> Column:
    return F.col("entity_type").eqNullSafe("evaluation")


def is_agent_row() -> Column:
    return F.coalesce(F.col("root_entity_type").isin(*AGENT_TYPES), F.lit(False)) & ~is_evaluation_row()


def is_skill_run_row() -> Column:
    return F.col("root_entity_type").eqNullSafe("skill")


def is_run_row() -> Column:
    return F.coalesce((F.col("entity_id") == F.col("root_entity_id")) & (F.col("entity_type") == F.col("root_entity_type")), F.lit(False))


def manual_run() -> Column:
    return F.col("trigger_source").isNull() | F.col("trigger_source").isin(*MANUAL_SOURCES)


def role_filter(events: DataFrame, members: DataFrame, roles: list[str]) -> DataFrame:
    """Events whose role snapshot has one of roles, or that have none and whose user has one now.

    members: project_id, user_id, role.
    """
    now = members.where(F.col("role").isin(*roles)).select("project_id", "user_id").distinct().withColumn("_now", F.lit(True))
    wanted = F.array(*map(F.lit, roles))
    joined = events.join(now, ["project_id", "user_id"], "left")
    return joined.where(F.when(F.col("role_snapshot").isNull(), F.col("_now").isNotNull()).otherwise(F.arrays_overlap("role_snapshot", wanted))).drop("_now")


def search_like(column: str, text: str) -> Column:
    """Case-insensitive part of a value; % and _ of the reader stay wildcards."""
    return F.col(column).ilike(f"%{text}%")


def outsiders_anti(events: DataFrame, members: DataFrame, super_admins: DataFrame) -> DataFrame:
    """Events without those of active super-admins who aren't members of the project."""
    outside = super_admins.select("user_id").join(members.select("user_id").distinct(), "user_id", "left_anti")
    return events.join(outside, "user_id", "left_anti")


def eval_runs_anti(rows: DataFrame, events: DataFrame) -> DataFrame:
    """rows whose run isn't an evaluation run; rows without run id stay."""
    runs = events.where(is_evaluation_row()).select("run_id").where(F.col("run_id").isNotNull()).distinct()
    return rows.join(runs, "run_id", "left_anti")
