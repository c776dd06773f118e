"""Stored scores of runs and their daily rollup, kept by what has changed; roles filled in where events lack them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterfold.operators import complexity as X
from meterfold.operators.ingest import backfill_roles
from meterfold.streaming.commits import Commit, CommitLog
from meterfold.streaming.jobs import LANDED, by_month, month_counts

RUN = ["project_id", "run_id"]
ENTITY = ["project_id", "root_entity_type", "root_entity_id"]
TEXT, LONG, NUMBER = T.StringType(), T.LongType(), T.DoubleType()
_SCORE = {"project_id": LONG, "run_id": TEXT, "ts": T.TimestampType(), "last_event_at": T.TimestampType(), "peak_input_tokens": LONG, "llm_calls": LONG, "tool_calls": LONG, "root_entity_type": TEXT, "root_entity_id": LONG, "root_entity_version_id": LONG, "conversation_id": TEXT, "trigger_source": TEXT, "cu_context": NUMBER, "cu_llm": NUMBER, "cu_tools": NUMBER, "cu_total": NUMBER}
#: The day, and the day or month by which files are kept apart.
DAY = T.StructField("day", T.DateType()), T.StructField("part", T.DateType())
SCORE = T.StructType([*[T.StructField(n, t) for n, t in _SCORE.items()], *DAY])
DAILY = T.StructType([*[T.StructField(n, t) for n, t in zip(ENTITY, (LONG, TEXT, LONG), strict=True)], T.StructField("runs", LONG), T.StructField("cu_sum", NUMBER), T.StructField("cu_max", NUMBER), T.StructField("histogram", T.ArrayType(LONG)), *DAY])


def daily_keys(changed: DataFrame, before: DataFrame) -> DataFrame:
    """The (entity, day) rows that change with some runs: where they are now, and where they were before, by their stored scores.

    changed and before: project_id, run_id, day and the root entity; before may hold other runs too.
    """
    was = before.join(changed.select(*RUN).distinct(), RUN, "left_semi")
    both = changed.select(*ENTITY, "day").unionByName(was.select(*ENTITY, "day"))
    return both.where("root_entity_id IS NOT NULL").distinct()


def _same(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join by entity and day, of which the type may be null."""
    a, b = left.alias("a"), right.alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*ENTITY, "day"]]
    return a.join(b, on[0] & on[1] & on[2] & on[3], how)


def in_grain(df: DataFrame, grain: str) -> DataFrame:
    return df.withColumn("part", F.trunc("day", "MM") if grain == "month" else F.col("day"))


def touched_parts(changed: DataFrame, grain: str) -> list[str]:
    """Parts that changed runs are in or may have been in: a run begins no later than it did, and not after its last event."""
    days = changed.select(F.explode(F.sequence(F.to_date("ts"), F.to_date("last_event_at"), F.expr("INTERVAL 1 DAY"))).alias("day"))
    return sorted(str(r[0]) for r in in_grain(days, grain).select("part").distinct().collect())


def keep_scores(log: CommitLog, commit: Commit, scored: DataFrame, grain: str = "day") -> Commit:
    """The commit after changed runs have their new scores (score_runs) and the rollup follows.

    Only the days (or, with grain, months) that these runs are or were in are read and written, and in them only the
    affected keys are worked out anew; others keep their files. Scores and rollup change as one.
    """
    fresh = in_grain(scored.withColumn("day", F.to_date("ts")), grain).select(*SCORE.fieldNames())
    name = log.write(fresh, "changed", commit.next, commit.next)
    changed = log.spark.read.schema(SCORE).parquet(f"{log.root}/{name}")
    parts = touched_parts(changed, grain)
    if not parts:
        return commit
    before = log.read("scores", SCORE, log.in_parts(commit.runs, "scores", "part", parts))
    scores = before.join(changed.select(*RUN).distinct(), RUN, "left_anti").unionByName(changed)
    keys = daily_keys(changed, before)
    stays = _same(log.read("daily", DAILY, log.in_parts(commit.runs, "daily", "part", parts)), keys, "left_anti")
    rebuilt = in_grain(X.complexity_daily(_same(scores, keys, "left_semi")), grain)
    dealt = lambda df: df.hint("rebalance", "part")
    return log.replace_parts(commit, "part", parts, {"scores": dealt(scores), "daily": dealt(stays.unionByName(rebuilt.select(*DAILY.fieldNames())))})


def read_scores(log: CommitLog, commit: Commit | None = None) -> DataFrame:
    return log.read("scores", SCORE, (commit or log.newest()).runs)


def read_daily(log: CommitLog, commit: Commit | None = None) -> DataFrame:
    return log.read("daily", DAILY, (commit or log.newest()).runs)


def fill_roles(log: CommitLog, commit: Commit, members: DataFrame) -> tuple[Commit, dict[str, int]]:
    """Current roles for the ingested events that have no snapshot: the commit after it, and how many rows changed in each month.

    Months in which nothing can be filled in keep their files; the others are written whole, and one commit puts all in
    place, so that a run that is killed changes nothing. To be called by the log's writer, or while none runs.
    """
    events = log.read("events", LANDED, commit.runs)
    lacking = events.where("role_snapshot IS NULL").select("project_id", "user_id", "event_month", F.col("role_snapshot"))
    counts = {str(r.event_month): r.n for r in backfill_roles(lacking, members).where("backfilled").groupBy("event_month").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return commit, {}
    months = sorted(counts)
    own = log.read("events", LANDED, log.in_parts(commit.runs, "events", "event_month", months)).where(F.col("event_month").isin(*[F.to_date(F.lit(m)) for m in months]))
    filled = backfill_roles(own, members).select(*LANDED.fieldNames())
    return log.replace_parts(commit, "event_month", months, {"events": by_month(filled, month_counts(own))}), counts
