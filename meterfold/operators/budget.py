"""Budget state, warnings and refusals from counters and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterfold.functions.columns import warning_level

#: Percent from which a personal project, and any other, warns.
PERSONAL_THRESHOLD, THRESHOLD = 60, 75


def scope_rows(counters: DataFrame, limits: DataFrame, feature: str = "") -> DataFrame:
    """Spend and limit of each project (user 0) and member of one month's counters, for model calls or one paid feature."""
    own = counters.where(F.col("model_name") == feature).select("project_id", "user_id", F.col("cost_nano_usd").alias("spent_nano"))
    whole = F.col("user_id") == 0
    joined = own.join(limits, "project_id")
    return joined.select(
        "project_id",
        "user_id",
        F.when(whole, "project").otherwise("member").alias("scope"),
        "spent_nano",
        F.when(whole, F.col("project_limit_nano")).otherwise(F.col("member_limit_nano")).alias("limit_nano"),
        "enabled",
        F.when(F.col("is_personal"), PERSONAL_THRESHOLD).otherwise(THRESHOLD).alias("threshold"),
    )


def budget_state(scopes: DataFrame) -> DataFrame:
    """Remaining amount, never below zero, and percent used; both null without a limit."""
    limit = F.col("limit_nano")
    remaining = F.when(limit.isNotNull(), F.greatest(F.lit(0), limit - F.col("spent_nano")))
    percent = F.when(limit > 0, F.bround(F.col("spent_nano") * 100 / limit, 2))
    return scopes.select("project_id", "user_id", "scope", "spent_nano", "limit_nano", remaining.alias("remaining_nano"), percent.alias("percent"))


def _for_members(scopes: DataFrame, members: DataFrame, how: str) -> DataFrame:
    """Each member with the rows of their project and of themselves; a project has one row, so that members stay as many."""
    own = members.select("project_id", "user_id").distinct()
    whole = scopes.where("user_id = 0").drop("user_id")
    single = scopes.where("user_id <> 0")
    joined = own.join(whole, "project_id", how).unionByName(own.join(single, ["project_id", "user_id"], how))
    return joined.withColumnRenamed("user_id", "member_id")


def best_warnings(scopes: DataFrame, members: DataFrame) -> DataFrame:
    """The highest level that each member sees where limits are enforced; their own scope wins ties."""
    rows = _for_members(scopes.where("enabled"), members, "inner")
    rows = rows.withColumn("level", warning_level(F.col("spent_nano"), F.col("limit_nano"), F.col("threshold"))).where("level IS NOT NULL")
    best = Window.partitionBy("project_id", "member_id").orderBy(F.col("level").desc(), F.col("scope"))
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("project_id", "member_id", "scope", "level")


def budget_door(scopes: DataFrame, members: DataFrame) -> DataFrame:
    """closed_by: project or member, the project checked first, where spend has reached an enforced limit; null is open."""
    rows = _for_members(scopes.where("enabled"), members, "left")
    shut = lambda scope: F.max(F.when((F.col("scope") == scope) & (F.col("spent_nano") >= F.col("limit_nano")), 1).otherwise(0)) == 1
    return rows.groupBy("project_id", "member_id").agg(F.when(shut("project"), "project").when(shut("member"), "member").alias("closed_by"))
