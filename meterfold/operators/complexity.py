"""Run complexity: per-run aggregates, scores, daily histograms, calibration and the views over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterfold.operators.joins import to_all_if_few
from meterfold.operators.quantiles import quantiles
from meterfold.scratch import materialised

#: Fixed values of the score: cap of the context part, histogram bounds, thresholds before calibration.
CONTEXT_CAP = 30.0
BOUNDS = [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0, 256.0, 512.0, 1024.0, 2048.0]
DEFAULT_THRESHOLDS = (10.0, 25.0, 60.0)
#: So many events are a task's share of the scoring, however many there are.
EVENTS_A_TASK = 250_000
EMBEDDINGS = r"/embeddings?(/|$)|/embed$"


@dataclass(frozen=True)
class Calibration:
    days: int = 30
    newest: int = 50
    min_runs: int = 200
    min_entities: int = 10


def window_runs(events: DataFrame, start, end) -> DataFrame:
    """(project, run) with activity in (start, end]."""
    return events.where((F.col("ts") > F.lit(start)) & (F.col("ts") <= F.lit(end)) & F.col("run_id").isNotNull()).select("project_id", "run_id").distinct()


def by_run(events: DataFrame, a_task: int = EVENTS_A_TASK) -> DataFrame:
    """Events of runs, dealt once so that a run's lie in one task: what is joined and grouped by run stays there, and a task's share doesn't grow."""
    rows = events.where("run_id IS NOT NULL")
    return rows.repartition(rows.count() // a_task + 1, "project_id", "run_id")


def run_rows(events: DataFrame, runs: DataFrame) -> DataFrame:
    """All events of those runs, whenever they were."""
    return events.join(runs, ["project_id", "run_id"], "left_semi")


def run_aggregates(rows: DataFrame) -> DataFrame:
    call = (F.col("event_type") == "llm") & ~F.coalesce("is_error", F.lit(False)) & ~F.coalesce(F.col("endpoint").rlike(EMBEDDINGS), F.lit(False))
    return rows.groupBy("project_id", "run_id").agg(
        F.min("ts").alias("ts"),
        F.max("ts").alias("last_event_at"),
        F.coalesce(F.max(F.when(call, F.col("input_tokens"))), F.lit(0)).alias("peak_input_tokens"),
        F.count_if(call).alias("llm_calls"),
        F.count_if(F.col("event_type") == "tool").alias("tool_calls"),
        *[F.max(c).alias(c) for c in ("root_entity_type", "root_entity_id", "root_entity_version_id", "conversation_id", "trigger_source")],
    )


def run_tool_counts(rows: DataFrame) -> DataFrame:
    kit = F.get_json_object("meta", "$.toolkit_type").alias("toolkit_type")
    return rows.where("event_type = 'tool' AND tool_name IS NOT NULL").groupBy("project_id", "run_id", "tool_name", kit).agg(F.count("*").alias("calls"))


def tool_weights(counts: DataFrame, weights: DataFrame, default: int = 1) -> DataFrame:
    """weight of each row: that of toolkit:tool, else that of the tool's bare name, else the default."""
    bare = F.substring_index("tool_name", "__", -1)
    weights = to_all_if_few(weights)
    special = weights.select(F.col("tool").alias("_key"), F.col("weight").alias("_special"))
    plain = weights.select(F.col("tool").alias("_bare"), F.col("weight").alias("_plain"))
    keyed = counts.withColumn("_bare", bare).withColumn("_key", F.concat_ws(":", "toolkit_type", "_bare"))
    joined = keyed.join(special, (keyed["_key"] == special["_key"]) & keyed["toolkit_type"].isNotNull(), "left").drop(special["_key"]).join(plain, "_bare", "left")
    return joined.withColumn("weight", F.coalesce("_special", "_plain", F.lit(default))).drop("_key", "_bare", "_special", "_plain")


def score_runs(runs: DataFrame, counts: DataFrame, weights: DataFrame, cutoff=None) -> DataFrame:
    """cu_context, cu_llm, cu_tools and cu_total of runs that did any work and were quiet by the cutoff."""
    tools = tool_weights(counts, weights).groupBy("project_id", "run_id").agg(F.sum(F.col("weight") * F.col("calls")).alias("_tools"))
    own = runs.where("llm_calls + tool_calls > 0")
    if cutoff is not None:
        own = own.where(F.col("last_event_at") <= F.lit(cutoff))
    joined = own.join(tools, ["project_id", "run_id"], "left")
    context = F.bround(F.least(F.greatest(F.col("peak_input_tokens"), F.lit(0)) / 1000.0, F.lit(CONTEXT_CAP)), 3)
    parts = {"cu_context": context, "cu_llm": F.col("llm_calls").cast("double"), "cu_tools": F.coalesce("_tools", F.lit(0)).cast("double")}
    joined = joined.withColumns(parts).drop("_tools")
    return joined.withColumn("cu_total", F.bround(F.col("cu_context") + F.col("cu_llm") + F.col("cu_tools"), 3))


def complexity_daily(scored: DataFrame) -> DataFrame:
    """Per project, root entity and UTC day: sums, maximum, and counts between the powers of two; the last bucket is open."""
    cu = F.col("cu_total")
    edges = [None, *BOUNDS, None]
    counts = []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        inside = F.lit(True)
        if low is not None:
            inside = inside & (cu >= low)
        if high is not None:
            inside = inside & (cu < high)
        counts.append(F.count_if(inside))
    return scored.where("root_entity_id IS NOT NULL").groupBy("project_id", "root_entity_type", "root_entity_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("runs"), F.sum("cu_total").alias("cu_sum"), F.max("cu_total").alias("cu_max"), F.array(*counts).alias("histogram"))


def histogram_median(histogram: Column, runs: Column, cu_sum: Column, cu_max: Column) -> Column:
    """The average for one or two runs, else a place within the bucket that half of the runs reach, as far in as they do."""
    step = F.aggregate(
        F.zip_with(histogram, F.array(*[F.struct(F.lit(a).alias("low"), (F.lit(b) if b is not None else F.lit(None).cast("double")).alias("high")) for a, b in zip([0.0, *BOUNDS], [*BOUNDS, None], strict=True)]), lambda n, b: F.struct(n.alias("n"), b.low.alias("low"), b.high.alias("high"))),
        F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("double").alias("at")),
        lambda acc, b: F.struct(
            (acc["before"] + b["n"]).alias("before"),
            F.coalesce(acc["at"], F.when((acc["before"] + b["n"]) * 2 >= runs, b["low"] + (F.least(F.coalesce(b["high"], cu_max), F.greatest(cu_max, b["low"])) - b["low"]) * (runs / 2.0 - acc["before"]) / b["n"])).alias("at"),
        ),
        lambda acc: acc["at"],
    )
    return F.when(runs <= 2, cu_sum / runs).otherwise(step)


def calibrate(scored: DataFrame, today, c: Calibration = Calibration()) -> DataFrame:
    """One row: runs, entities, p75, p90, p99 and the 99 percentiles over the newest runs of each entity."""
    newest = Window.partitionBy("project_id", "root_entity_type", "root_entity_id").orderBy(F.col("ts").desc(), F.col("run_id"))
    own = scored.where((F.col("ts") >= F.date_sub(F.lit(today), c.days)) & (F.col("ts") < F.lit(today)) & F.col("root_entity_id").isNotNull())
    own = own.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= c.newest)
    own = materialised(own.select("project_id", "root_entity_type", "root_entity_id", "cu_total"), "sample")
    entities = F.countDistinct("project_id", "root_entity_type", "root_entity_id")
    marks = quantiles(own, [], "cu_total", [k / 100 for k in range(1, 100)]).withColumnRenamed("quantiles", "breakpoints")
    out = own.agg(F.count("*").alias("sample_runs"), entities.alias("sample_entities")).join(F.broadcast(marks), F.lit(True), "left")  # rows of one
    return out.select("sample_runs", "sample_entities", *[F.col("breakpoints")[k - 1].alias(f"p{k}") for k in (75, 90, 99)], "breakpoints")


def resolve_thresholds(calibrated: DataFrame, c: Calibration = Calibration(), default: tuple[float, float, float] = DEFAULT_THRESHOLDS, pins: tuple[float, float, float] | None = None) -> DataFrame:
    """medium, high, extreme and where they come from: pins that rise, else a large enough sample's quantiles that rise, else the default."""
    marks = [F.bround(f"p{k}", 1) for k in (75, 90, 99)]
    usable = (F.col("sample_runs") >= c.min_runs) & (F.col("sample_entities") >= c.min_entities) & (marks[0] > 0) & (marks[0] < marks[1]) & (marks[1] < marks[2])
    pinned = pins is not None and 0 < pins[0] < pins[1] < pins[2]
    source = F.lit("pinned") if pinned else F.when(F.coalesce(usable, F.lit(False)), "calibrated").otherwise("default")
    values = [F.lit(pins[k]) if pinned else F.when(F.coalesce(usable, F.lit(False)), marks[k]).otherwise(F.lit(default[k])) for k in range(3)]
    return calibrated.select(*[v.alias(n) for v, n in zip(values, ("medium", "high", "extreme"), strict=True)], source.alias("source"))


def complexity_entities(daily: DataFrame) -> DataFrame:
    """Each entity's runs, average, maximum and median from its summed histograms."""
    key = ["project_id", "root_entity_type", "root_entity_id"]
    sums = daily.groupBy(*key).agg(F.sum("runs").alias("runs"), F.sum("cu_sum").alias("cu_sum"), F.max("cu_max").alias("cu_max"), F.array(*[F.sum(F.col("histogram")[k]) for k in range(len(BOUNDS) + 1)]).alias("histogram"))
    return sums.withColumn("cu_median", histogram_median(F.col("histogram"), F.col("runs"), F.col("cu_sum"), F.col("cu_max"))).withColumn("cu_avg", F.col("cu_sum") / F.col("runs"))


def complexity_summary(rollup: DataFrame, exact: DataFrame) -> DataFrame:
    """Rollup rows with exact runs, maximum and median where retention removed no run."""
    key = ["project_id", "root_entity_type", "root_entity_id"]
    own = exact.where("root_entity_id IS NOT NULL").groupBy(*key).agg(F.count("*").alias("_runs"), F.max("cu_total").alias("_max"))
    joined = rollup.join(own, key, "left").join(medians(exact.where("root_entity_id IS NOT NULL"), key).withColumnRenamed("cu_median", "_median"), key, "left")
    whole = F.coalesce(F.col("_runs") >= F.col("runs"), F.lit(False))
    return joined.select(*key, F.when(whole, F.col("_runs")).otherwise(F.col("runs")).alias("runs"), F.when(whole, F.col("_max")).otherwise(F.col("cu_max")).alias("cu_max"), F.when(whole, F.col("_median")).otherwise(F.col("cu_median")).alias("cu_median"), whole.alias("exact"))


def medians(scored: DataFrame, keys: list[str]) -> DataFrame:
    """keys and cu_median, exact."""
    return quantiles(scored, keys, "cu_total", [0.5]).select(*keys, F.col("quantiles")[0].alias("cu_median"))


def complexity_versions(scored: DataFrame) -> DataFrame:
    """Runs and median of each version of an entity."""
    key = ["root_entity_id", "root_entity_version_id"]
    counts = scored.groupBy(*key).agg(F.count("*").alias("runs")).alias("c")
    own = medians(scored, key).alias("m")
    same = F.col("c.root_entity_id").eqNullSafe(F.col("m.root_entity_id")) & F.col("c.root_entity_version_id").eqNullSafe(F.col("m.root_entity_version_id"))
    return counts.join(own, same, "left").select("c.*", "cu_median")


def conversation_top_run(scored: DataFrame) -> DataFrame:
    best = Window.partitionBy("conversation_id").orderBy(F.col("cu_total").desc(), F.col("ts").desc(), F.col("run_id"))
    return scored.where("conversation_id IS NOT NULL").withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def complexity_freshness(state: DataFrame, now, hours: int = 26) -> DataFrame:
    """stale: never computed, or more than so many hours ago."""
    limit = F.lit(now) - F.make_dt_interval(F.lit(0), F.lit(hours))
    return state.withColumn("stale", F.col("computed_at").isNull() | (F.col("computed_at") < limit))


def expire_daily(daily: DataFrame, today, months: int) -> DataFrame:
    """Daily rows that stay: those since the first of the month so many months before today."""
    return daily.where(F.col("day") >= F.add_months(F.trunc(F.lit(today), "MM"), -months))
